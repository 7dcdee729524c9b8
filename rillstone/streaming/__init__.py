"""Reviews as a stream of deliveries."""
