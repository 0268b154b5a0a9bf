"""End-to-end flows composed of the operators."""
