from millrace.plans.returned_revenue import returned_revenue, returned_revenue_from

__all__ = ["returned_revenue", "returned_revenue_from"]
