"""Column functions: text, time codes, similarity. Pure expressions unless noted."""
