"""Reading corpora and tables, writing results."""
