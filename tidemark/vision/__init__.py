"""Frame features: numpy kernels run on batches of frames by Arrow UDFs."""
