"""Values that results depend on, stated once, as plain text.

Nothing here is logic: thresholds, patterns, header names and label tables.
"""

# --- Fixed values: scope of the pool and units -------------------------------
CITY_TEXT = "Hồ Chí Minh"
SALE_PRICE_FLOOR = 500_000_000
MILLION = 1_000_000
NUMBER_PATTERN = r"([0-9]+(?:\.[0-9]+)?)"

# --- Fixed values: market tier of each district, 1 cheap ... 5 expensive -----
DISTRICT_TIERS = {
    "Quận 1": 5,
    "Quận 3": 5,
    "Quận 4": 4,
    "Quận 5": 4,
    "Quận 6": 3,
    "Quận 7": 4,
    "Quận 8": 2,
    "Quận 10": 4,
    "Quận 11": 3,
    "Quận 12": 2,
    "Quận Bình Tân": 2,
    "Quận Bình Thạnh": 4,
    "Quận Gò Vấp": 3,
    "Quận Phú Nhuận": 4,
    "Quận Tân Bình": 4,
    "Quận Tân Phú": 3,
    "Thành phố Thủ Đức": 3,
    "Huyện Bình Chánh": 1,
    "Huyện Cần Giờ": 1,
    "Huyện Củ Chi": 1,
    "Huyện Hóc Môn": 1,
    "Huyện Nhà Bè": 1,
}

# --- Fixed values: numeric codes of an ad and their labels -------------------
CODE_LABELS = {
    "direction": {
        1: "Đông", 2: "Tây", 3: "Nam", 4: "Bắc",
        5: "Đông Nam", 6: "Tây Nam", 7: "Đông Bắc", 8: "Tây Bắc",
    },
    "category": {
        1000: "Nhà đất",
        1010: "Căn hộ/Chung cư",
        1020: "Nhà ở",
        1030: "Đất",
        1040: "Văn phòng/Mặt bằng",
        1050: "Phòng trọ",
    },
    "interior": {
        1: "Nội thất đầy đủ",
        2: "Nội thất cơ bản",
        3: "Không nội thất",
    },
    "legal": {
        1: "Sổ đỏ/Sổ hồng",
        2: "Hợp đồng mua bán",
        3: "Giấy tờ hợp lệ khác",
        4: "Đang chờ sổ",
        5: "Sổ chung",
        6: "Khác",
    },
    "apartment_type": {
        1: "Chung cư",
        2: "Duplex",
        3: "Penthouse",
        4: "Studio",
        5: "Officetel",
        6: "Shophouse",
    },
}

# --- Fixed values: ids looked up in an ad's id/value array -------------------
INTERIOR_ITEM_ID = "furnishing_sell"
LEGAL_ITEM_ID = "legal_documents"

# --- Fixed values: counts mentioned in the body text -------------------------
FLOORS_IN_TEXT = r"(\d+)\s*tầng"
BEDROOMS_IN_TEXT = r"(\d+)\s*(?:phòng ngủ|PN)"

# --- Fixed values: seed CSV headers and the fields they stand for ------------
SEED_HEADERS = {
    "STT": "ad_id",
    "Tieu de": "title",
    "Gia (VND)": "price",
    "Dien tich": "area",
    "Dia chi": "ward",
    "Quan/Huyen": "district",
    "Thanh pho": "city",
    "Loai BDS": "property_type",
    "Phong ngu": "bedrooms",
    "So tang": "floors",
    "Huong": "direction",
    "Ngay dang": "posted_at",
    "URL": "url",
    "Thoi gian crawl": "crawled_at",
}

# --- Fixed values: outlier bounds and fills ----------------------------------
IQR_K = 1.5
IQR_COLUMNS = ("price_per_m2", "area")
FLOORS_FILL = 1
BEDROOMS_FALLBACK = 1
UNKNOWN = "UNKNOWN"

# --- Fixed values: macro context ---------------------------------------------
GATE_MIN_SPAN_DAYS = 183
GATE_MIN_MONTHS = 3
TRAILING_DAYS = 90
MARKET_SERIES = ("vnindex", "usdvnd", "gold")
MONTHLY_SERIES = ("cpi", "rate")
MONTH_LAGS = (1, 3, 6)
QUARTER_LAGS = (1, 4)
MONTH_FORM_START = "2025-01-01"
MONTH_FORM_AHEAD = 12

# --- Fixed values: scoring, drift, report ------------------------------------
LABEL = "price_per_m2"
UNDERVALUED_FROM = 0.20
DRIFT_MULTIPLIER = 1.5
TRAIN_PERCENT = 80
SEED = 42
FOLDS = 3
TOP_ROWS = 15
GAP_EDGES = (-20.0, -10.0, 0.0, 10.0, 20.0)
GAP_LABELS = ("< −20%", "−20…−10%", "−10…0%", "0…10%", "10…20%", "> 20%")

MARKET_COLUMNS = [f"{s}_90d_{kind}" for s in MARKET_SERIES for kind in ("ma", "pct")]
MONTHLY_COLUMNS = [
    f"{s}_{kind}" for s in MONTHLY_SERIES for kind in ("1m_lag", "3m_lag", "6m_lag", "90d_pct")
]
CONTEXT_COLUMNS = MARKET_COLUMNS + MONTHLY_COLUMNS
