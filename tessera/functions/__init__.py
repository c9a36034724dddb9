"""Series functions: native column expressions (``columns``) and their NumPy twins (``kernels``)."""
