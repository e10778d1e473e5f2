"""plumbline: composable DataFrame operators that measure text corpora and the detectors that run over them."""
