"""DataFrame-to-DataFrame operators, composable with ``DataFrame.transform``."""
