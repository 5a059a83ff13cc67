"""Sequential detectors: chunk kernels and the job that links chunks."""
