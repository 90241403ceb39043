"""Column functions and driver-side helpers for time ranges, JSON values and metrics."""
