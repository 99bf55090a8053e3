"""lodestone: queries, checks and planning over collections of Markdown notes, as Spark jobs."""
