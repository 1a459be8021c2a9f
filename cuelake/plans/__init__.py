"""End-to-end plans: table views, the live caption chain and the query catalogue."""
