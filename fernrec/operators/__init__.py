"""DataFrame operators of the recommender (see README for the inventory)."""
