"""Terms and FILTER expressions as native columns."""
