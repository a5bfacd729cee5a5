"""Domain constants: the single place where they are stated."""

# Fixed values of the domain
PITCH_LENGTH, PITCH_WIDTH = 120.0, 80.0
GOAL_X, GOAL_Y = 120.0, 40.0
POST_LOW, POST_HIGH = 36.0, 44.0
PROGRESSIVE_SHARE = 0.25
LONG_PASS = 30.0
FINAL_THIRD = 80.0
RELIABLE_PASSES, RELIABLE_SUBSET, RELIABLE_SHOTS = 100, 20, 20
LEAST_PEERS = 10
OUTFIELD = ("DEF", "MID", "FWD")
LEAST_POOL_PASSES, LEAST_POOL_CARRIES = 50, 29
HIGHER_SUPPORT_MATCHES = 3
