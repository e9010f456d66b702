"""Names of the columns that every operator reads or adds."""

FEATURES = "features"
WEIGHT = "weight"
PREDICTION = "prediction"
NOISE = -1
