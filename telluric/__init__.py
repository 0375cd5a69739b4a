"""telluric: geomagnetic field reconstruction and corpus preparation as Spark jobs."""
