"""Reading tables and documents, and what is known of them together."""
