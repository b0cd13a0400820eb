"""Complete flows composed from the operators."""
