"""Fixed values of the method; results depend on them."""

# Guards: division, Box-Cox input, logarithm in the criterion, softmax weights, shapes and spreads.
TINY = 1e-10
TINY_BOXCOX = 1e-8
TINY_LOG = 1e-30
TINY_WEIGHT = 1e-15
TINY_SHAPE = 1e-6
# Inverse Box-Cox exponents stay within this; with fewer positive values the power is 1.
EXPONENT_LIMIT = 30.0
LEAST_POSITIVE = 10
# Complete periods: least and most.
LEAST_PERIODS = 3
MOST_PERIODS = 500
# Periods averaged into the shape; residual columns kept for noise.
SHAPE_PERIODS = 2
NOISE_PERIODS = 50
# Ridge penalties: 10 ** (-4 + i / 3) for i in 0..24.
PENALTIES = tuple(10.0 ** (-4 + i / 3) for i in range(25))

# Primary period by frequency code.
FREQ_TO_PERIOD = {"S": 60, "T": 60, "5T": 12, "10T": 6, "15T": 4, "30T": 48, "10S": 6, "H": 24, "D": 7, "W": 52, "M": 12, "Q": 4, "A": 1, "Y": 1}
# Candidate periods by frequency code.
FREQ_TO_PERIODS = {"10S": [6, 360], "S": [60], "5T": [12, 288], "10T": [6, 144], "15T": [4, 96], "30T": [48, 336], "H": [24, 168], "D": [7, 365], "W": [52], "M": [12], "Q": [4], "A": [], "Y": []}
# Anchored suffixes that shorten to their first letter.
ANCHORED = ("ME", "QE", "YE", "MS", "QS", "YS", "AS")

# Seasons that error scales of evaluations take, by base frequency; a multiple of it divides the season, or there is none.
SEASONS = {"S": 3600, "T": 1440, "H": 24, "D": 1, "B": 5, "W": 1, "M": 12, "Q": 4, "A": 1, "Y": 1}
