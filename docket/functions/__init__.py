"""docket."""
