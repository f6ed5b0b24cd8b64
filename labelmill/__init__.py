"""labelmill: batch labelling, answer parsing, voting and evaluation as Spark jobs."""
