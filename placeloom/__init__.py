"""placeloom: curation and analytics of place, photo, evidence and visit tables as Spark jobs."""
