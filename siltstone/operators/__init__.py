"""Plans over units, postings and sections."""
