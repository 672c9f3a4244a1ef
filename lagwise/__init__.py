"""Leak-free features from time-ordered event logs, as DataFrame -> DataFrame functions."""
