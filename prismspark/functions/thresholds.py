"""Every screening threshold of the rules, stated once. They mark review priority, never a conclusion."""

SPECTRAL_PEAKS = 4
RATIO_LOW, RATIO_HIGH = 0.30, 1.25
QUADRANT_CV = 0.01
NOISE_CV = SENSOR_CV = 0.75
TEXTURE_RATIO, TEXTURE_SIGMA = 0.55, 0.02
RESAMPLING_PERSISTENCE = 0.94
HAMMING, DISTANCE_PX, BIN_PX, CLUSTER_N, CLUSTER_HAMMING, CLUSTER_STD = 55, 40.0, 8.0, 10, 40.0, 1.2
REFERENCE_FLOOR, ROBUST_SIGMA, MAD_SCALE, COMPONENT_AREA = 12.0, 8.0, 1.4826, 50
DUPLICATE_MAD, TRANSITION_FLOOR, MOTION_Z, GAP_FACTOR = 0.05, 0.01, 2.0, 1.8
SHARPNESS_CV, DCT_RATIO_CV = 1.0, 0.75
FUSION_HIGH, FUSION_MODERATE = 4, 2
MODEL_SCORE = 0.5
WILSON_Z = 1.959963984540054
