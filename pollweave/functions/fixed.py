"""Fixed values.

Everything in this module is a value that has to be exactly what it is for the
results to be right: code tables, labels, colours, thresholds and formats.
"""

# Owner code -> faction label. Codes outside the table read as UNKNOWN.
OWNER_CODES = {0: "Humans", 1: "Humans", 2: "Terminids", 3: "Automaton", 4: "Illuminate"}
UNKNOWN = "Unknown"

# Sector code -> sector name. Codes outside the table read as "".
SECTOR_CODES = {
    0: "Sol", 1: "Barnard", 2: "Tau Ceti", 3: "Pictor", 4: "Titania", 5: "Canopus",
    6: "Kessel", 7: "Yezub", 8: "Angels Venture", 9: "Crux", 10: "Ursa Major",
    11: "Kronos", 12: "Draco", 13: "Rictus", 14: "Aurora", 15: "Jin Xi",
    16: "Fenrir", 17: "Meridian", 18: "Valdis", 19: "Farsight", 20: "Gacrux",
}

# One faction goes by two labels; display tables know the plural.
FACTION_ALIASES = {"Automaton": "Automatons"}

# Faction label -> local display name.
OWNER_LOCAL = {
    "Humans": "超级地球",
    "Automatons": "机器人",
    "Terminids": "终结族",
    "Illuminate": "光能族",
}

# Display colours, each with the colour of a label outside the table.
OWNER_COLOURS = {
    "Humans": "#3b82f6", "Automatons": "#ef4444", "Terminids": "#f59e0b", "Illuminate": "#8b5cf6",
}
OWNER_COLOUR_DEFAULT = "#64748b"
CONTEST_COLOURS = {
    "Terminids": "#f59e0b", "Automaton": "#ef4444", "Automatons": "#ef4444",
    "Illuminate": "#8b5cf6", "Humans": "#3b82f6",
}
CONTEST_COLOUR_DEFAULT = "#94a3b8"
RACE_CODE_COLOURS = {1: "#f59e0b", 2: "#ef4444", 3: "#8b5cf6", 4: "#3b82f6"}
SECTOR_COLOURS = {
    "半藏": "rgba(59, 130, 246, 1)", "阿基拉": "rgba(239, 68, 68, 1)",
    "欧米茄": "rgba(139, 92, 246, 1)", "寂域": "rgba(16, 185, 129, 1)",
    "猎户座": "rgba(245, 158, 11, 1)", "法尔赛特": "rgba(14, 165, 233, 1)",
    "太阳系": "rgba(59, 130, 246, 1)", "巴纳德": "rgba(34, 197, 94, 1)",
    "康古利伊": "rgba(168, 85, 247, 1)", "坎托鲁斯": "rgba(249, 115, 22, 1)",
    "塞勒斯特": "rgba(14, 165, 233, 1)", "天龙": "rgba(239, 68, 68, 1)",
    "斯坦": "rgba(236, 72, 153, 1)", "仙女座": "rgba(236, 72, 153, 1)",
    "阿图里昂": "rgba(34, 197, 94, 1)", "阿尔斯特拉德": "rgba(249, 115, 22, 1)",
    "阿尔特斯": "rgba(14, 165, 233, 1)", "博格斯": "rgba(168, 85, 247, 1)",
    "坎克里": "rgba(16, 185, 129, 1)", "锦栖": "rgba(236, 72, 153, 1)",
    "默里迪亚": "rgba(139, 92, 246, 1)", "土卫十九": "rgba(34, 197, 94, 1)",
    "霍金": "rgba(245, 158, 11, 1)", "瓦尔迪斯": "rgba(236, 72, 153, 1)",
    "未知星区": "rgba(100, 116, 139, 1)",
}
SECTOR_COLOUR_DEFAULT = "rgba(100, 116, 139, 1)"
SECTOR_MISSING = "未知星区"

# Weapon class code -> local name.
WEAPON_CLASSES = {
    "STG": "霰弹枪", "LMG": "轻机枪", "RLF": "步枪", "SMG": "冲锋枪",
    "DMR": "半自动步枪", "PIS": "手枪", "KNF": "近战武器", "OTH": "其他",
}

# The separate layer, by English and by local region name.
VOID_REGION = "The Void"
VOID_REGION_LOCAL = "寂域"

# Names and titles that stand in for missing ones.
SYNTHETIC_PREFIX = "PLANET_"
ASSIGNMENT_TITLE = "MAJOR ORDER"
NAME_MISSING = "未知"
OWNER_NONE = "None"

# Contest classes, and the codes that mean a defence.
DEFENSE, LIBERATION, RECON = "defense", "liberation", "recon"
DEFENSE_CODES = ["1", "4", "defense"]
RECON_CODE = 1

# Progress bands: above 50, above 25, above 0.
BAND_HIGH, BAND_MIDDLE, BAND_LOW = "#22c55e", "#f59e0b", "#ef4444"

# Thresholds.
MILLIS_ABOVE = 10_000_000_000  # a larger epoch counts milliseconds
ABSOLUTE_MAX_FLOOR = 1000  # a smaller maximum is a relative value
LEVEL_STEP = 50_000  # maximum health per level
DELTA_EPSILON = 0.01  # smaller changes of a progress have no rate
LOCAL_OFFSET_HOURS = 8

# Bounds on what is kept.
HISTORY_RECORDS = 288
BULLETINS_KEPT = 30
NEWS_KEPT = 5
REFRESH = "5 minutes"

# View geometry, in pixels.
VIEW_MARGIN = 60
GROUP_PAD = 20
SCALE_FIT, SCALE_MIN, SCALE_MAX = 1.5, 0.3, 3.0
HIT_RADIUS = 20
EDGE_SPAN = 600

# Text of a summary line.
SUMMARY_NAME = "📍 "
SUMMARY_OWNER = "阵营: "
SUMMARY_STATE = "战况: "
SUMMARY_STATE_DEFENSE, SUMMARY_STATE_OTHER = "防御战", "解放战"
SUMMARY_SECTOR = "星区: "
SUMMARY_HEALTH, SUMMARY_HEALTH_UNIT = "健康度: ", "%"
SUMMARY_HEALTH_MISSING = "--"
SUMMARY_PLAYERS = "玩家: "
