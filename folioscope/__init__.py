"""Analytics over corpora of notes, HTML pages and source code, as Spark jobs."""
