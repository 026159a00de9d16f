"""sitemill: Spark jobs for crawl access, record extraction, catalog quality,
pipeline observability and vectors."""
