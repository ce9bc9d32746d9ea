"""recitant: Spark-first narration engine (sources, chapters, chunks, jobs, parts, events)."""
