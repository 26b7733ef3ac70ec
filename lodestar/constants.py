"""Results depend on them, so they are stated here and nowhere else."""

# Pivot spacing, as a fraction of the data diameter (sparse spatial selection).
ALPHA = 0.37

# Numbers this close to zero count as zero.
EPSILON = 1e-9

# Side of the box window: envelope of a circle of this diameter.
BOX_SIDE = 309.0

# Random pivots: draws with replacement, out of the first points in order.
RANDOM_PIVOT_DRAWS = 100
RANDOM_PIVOT_POOL = 10_000

# Uniform generator: default number of points.
UNIFORM_POINTS = 10_000

# Geographic generator: x is negated, upper bounds are exclusive.
GEO_X_LOW, GEO_X_HIGH = 66.885444, 125.848974
GEO_Y_LOW, GEO_Y_HIGH = 24.396308, 50.384358

# Rows shown when previewing neighbours.
PREVIEW_ROWS = 11

# Identifiers.
POINT_PREFIX = "point_"
PIVOT_PREFIX = "pivot_"

# Positions (0-based) of x and y in the two text layouts.
DELIMITED_X, DELIMITED_Y = 2, 1
TSV_X, TSV_Y = 6, 5

# Quadrants around the centroid, in the order in which ties are settled.
UPPER_LEFT = "UPPER LEFT"
UPPER_RIGHT = "UPPER RIGHT"
LOWER_RIGHT = "LOWER RIGHT"
LOWER_LEFT = "LOWER LEFT"
QUADRANTS = (UPPER_LEFT, UPPER_RIGHT, LOWER_RIGHT, LOWER_LEFT)

# Row, family and qualifier names of the key-value layout.
POINT_COUNT_ROW = "!!!POINT_COUNT"
QUADRANT_ROW = "!!!QUADRANT"
