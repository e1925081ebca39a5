"""DataFrame-in, DataFrame-out operators over purchase lines and their aggregates."""
