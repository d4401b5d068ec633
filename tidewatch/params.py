"""Default parameters, fixed by the results to match."""

# Fixed values.
GUARD, BACKGROUND, PFA = 2, 8, 1e-6
AREA_MIN, AREA_MAX, NMS_IOU_AREA = 4, 5000, 0.3
SPECKLE_KERNEL = 7
TILE, OVERLAP, TILE_MIN = 800, 64, 16
CONF_MIN, NMS_IOU_CONF = 0.25, 0.45
AIS_RADIUS_KM, AIS_PAD_DEG, AIS_PAD_MINUTES, AIS_FALLBACK_HOURS = 2.0, 0.1, 30, 1
AOI = (-5.0, -5.0, 10.0, 5.0)
CHIP = 800
VESSEL_ASPECT, VESSEL_MIN_PX, VESSEL_DEFAULT_M, M_PER_PX = 3.0, 2.0, 20.0, 10.0
EVAL_IOU, EVAL_STEPS, BETA = 0.5, 50, 0.5
EARTH_KM = 6371.0
M_PER_DEG_LON, M_PER_DEG_LAT = 111320.0, 110540.0
CROP, CROPS = 64, 64
TRACK_IDS, EVENTS_LIMIT, SEARCH_LIMIT = 50, 500, 100
CLASS_NAMES = {0: "non_vessel", 1: "vessel", 2: "fishing_vessel"}
CONFIDENCE_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}
