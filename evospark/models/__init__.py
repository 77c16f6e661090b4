"""Regression surrogates and simulators: fitted on the driver from bounded windows, applied in bulk."""
