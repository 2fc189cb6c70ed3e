"""Column functions and views that the operators share."""
