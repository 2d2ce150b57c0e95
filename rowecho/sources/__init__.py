"""Reading datasets, lexicons, responses and score files; writing results."""
