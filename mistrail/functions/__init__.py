"""Column expressions and the small numeric kernels that run inside tasks."""
