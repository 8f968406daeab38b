"""Detectors over an issue feed and the stateful streams that follow them."""
