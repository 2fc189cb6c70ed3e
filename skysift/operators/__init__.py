"""Operators on waterfalls, spectra and candidates, as DataFrame algebra."""
