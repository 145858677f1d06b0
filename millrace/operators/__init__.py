from millrace.operators.totals import N_REFUSED, REFUSED, total_by

__all__ = ["N_REFUSED", "REFUSED", "total_by"]
