"""Column-expression builders and small numeric kernels."""
