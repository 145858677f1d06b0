from millrace.functions.amounts import (
    high_low,
    high_low_names,
    high_low_total,
    refused,
    whole_parts,
)

__all__ = ["high_low", "high_low_names", "high_low_total", "refused", "whole_parts"]
