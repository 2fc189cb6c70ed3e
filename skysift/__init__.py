"""Search of dispersed radio transients on Spark: sources, framing, statistics, dedispersion, detection, clustering."""
