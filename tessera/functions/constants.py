"""Lists, labels, limits and patterns that results must agree on."""

# Platforms and functions looked for in a request, in order of preference.
PLATFORMS = ("MEB", "MQB", "BEV", "Custom BEV", "Compact SUV")
FUNCTIONS = ("PM", "Chassis", "BIW", "CAE", "EE", "Interior", "GI", "Test validation")
DEFAULT_FUNCTIONS = ("PM", "Chassis")
MILESTONES = ("P1", "P2", "P3", "P4", "P5", "SOP")
MILESTONE_COLUMNS = ("P1", "P2", "P3", "P4", "P5", "P6", "P7", "SOP")

# Words that mark deliverables and special requirements, and what stands in where none is found.
DELIVERABLE_WORDS = ("M1", "M2", "M3", "data", "report", "3D")
DEFAULT_DELIVERABLES = ("M1/M2 3D data", "DMU check report")
REQUIREMENT_WORDS = ("边界", "Assumption", "载荷")
DEFAULT_REQUIREMENT = "边界载荷是否由客户提供"

# Comparison dimensions, derived rows and placeholders.
DIMENSIONS = ("平台类型", "车身材料", "仿真类型", "内外饰范围", "交付物数量")
SUMMARY_ROW, MAN_DAYS_ROW, DEVIATION_ROW = "技术差异总结", "实际人天", "偏差率（估→实）"
UNKNOWN, DASH, TO_PREDICT = "未知", "—", "待预测"
UNNAMED_PROJECT, UNKNOWN_PROJECT = "未命名项目", "未知项目"
HIGH, MEDIUM, LOW = "高", "中", "低"

# Planning constants.
MONTH_SLOTS, WORK_DAYS_PER_MONTH, DEFAULT_MONTHS, COMPLEX_FACTOR = 20, 22, 20, 1.1

# Staffing baseline; (function, position, tariff, share) and man-days of each function.
BASELINE_POSITIONS = (
    ("PM", "PM", "TE", 0.65),
    ("PM", "PMA", "M", 0.35),
    ("Chassis", "Chassis module leader", "TE", 0.12),
    ("Chassis", "Front suspension", "H & SW", 0.28),
    ("Chassis", "Rear suspension", "M & SW", 0.28),
    ("Chassis", "Steering", "M & SW", 0.18),
    ("Chassis", "Brake&Wheel", "M & SW", 0.14),
)
BASELINE_KEYS = ("default", "hozon")
BASELINE_DAYS = (("PM", 180.0), ("Chassis", 1100.0))

# Task states and the progress they stand for; review states in which a quote may be made.
TASK_STATES = (("pending", 0), ("parsing", 20), ("retrieving", 50), ("generating", 80), ("completed", 100), ("failed", 0))
QUOTABLE_REVIEWS = ("in_review", "approved", "exported")
UPLOAD_LIMIT = 50 * 1024 * 1024
STORED_CHARS, SUMMARY_CHARS, ERROR_CHARS, QUERY_CHARS, NAME_CHARS = 8000, 120, 200, 500, 80

# Functions of the summary sheet, in its order, and their descriptions.
SUMMARY_SHEET = "Manpower"
SUMMARY_FUNCTIONS = (("PM", "Project Management"), ("Chassis", "Chassis Engineering"))
