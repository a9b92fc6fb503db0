"""Fixed values of the method: what results depend on, stated once."""

EPSILON = 1e-12
FLOAT_MIN = 1.17549435e-38
OVERLAP = 4
ZERO_PADDING = 800
# Over-subtraction and suppression
ALPHA_MIN, ALPHA_MAX, ALPHA_MAX_TONAL = 1.0, 4.0, 10.0
DEFAULT_BETA = 0.01
SNR_LOW_DB, SNR_HIGH_DB = -5.0, 20.0
# Noise estimators
SILENCE = 1e-10
MARTIN_WINDOWS, MARTIN_FRAMES, MARTIN_BIAS, MARTIN_SMOOTHING = 8, 12, 1.5, 0.8
SPP_XI, SPP_POWER, SPP_SMOOTHING, SPP_CAP = 31.62, 0.8, 0.9, 0.99
BRANDT_MS, BRANDT_PERCENTILE, BRANDT_CONFIDENCE = 5000.0, 0.5, 0.90
BRANDT_MIN_FRAMES, BRANDT_MIN_MS, BRANDT_MIN_RANK = 5, 0.1, 10
BRANDT_SHARES = (0.1, 0.25, 0.5, 0.75, 1.0)
# Profiles
MEAN_FRAMES_AVAILABLE = 5
MEDIAN_FRAMES = 25
GAP_THRESHOLD, PROFILE_SMOOTHING = 1e-9, 0.5
# Tonal components
PEAK_RATIO, PEAK_PROMINENCE, TONAL_WINDOW = 1.41, 1e-7, 51
# Transients
ONSET_SENSITIVITY, ONSET_ENERGY, ONSET_SMOOTHING = 0.25, 1e-10, 0.8
# Masking
FULL_SCALE_SPL, SPREAD_EXPONENT, TIME_EXPONENT = 96.0, 0.4, 0.6
SLOPE_MIN, SLOPE_MAX, SLOPE_DOWN, SLOPE_REFERENCE, SLOPE_FACTOR = 5.0, 15.0, 25.0, 40.0, 0.2
TONE_OFFSET, NOISE_OFFSET, FLATNESS_DB = 14.5, 6.0, -60.0
FORWARD_LOW_S, FORWARD_HIGH_S, BACKWARD_S = 0.100, 0.025, 0.010
VETO_SMOOTHING, VETO_RANGE_DB = 0.5, 20.0
REFERENCE_HZ, REFERENCE_DB = 1000.0, 90.0
# Similarity filter
NLM_PATCH, NLM_BLOCK, NLM_FREQ, NLM_PAST, NLM_FUTURE = 8, 8, 8, 16, 4
NLM_FLOOR, NLM_LEAST_WEIGHT, NLM_FREQ_SCALE, NLM_DISTANCE = 1e-9, 1e-10, 3.0, 4.0
# Upper edges of critical bands in Hz
BARK_EDGES = (100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500, 12000, 15500, 19000)
OPUS_EDGES = (200, 400, 600, 800, 1000, 1200, 1400, 1600, 2000, 2400, 2800, 3200, 4000, 4800, 5600, 6800, 8000, 9600, 12000, 15600)
