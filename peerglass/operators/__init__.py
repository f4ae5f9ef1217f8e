"""DataFrame building blocks; every frame carries ``window_id`` as a key."""

WINDOW = ["window_id"]
COMBO = ["window_id", "segment", "archetype"]
