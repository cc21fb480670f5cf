"""Row-local column expressions and generators."""
