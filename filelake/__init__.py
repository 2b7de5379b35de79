"""filelake: Spark jobs that look inside large collections of files."""
