"""Lists, tables and limits that results depend on."""

from __future__ import annotations

UNKNOWN = "unknown"

#: Price bands in natural order: key, lowest, and the price from which the next begins.
PRICE_BANDS = [("under_30", None, 30), *((f"{a}_{a + 5}", a, a + 5) for a in range(30, 120, 5)), ("120_over", 120, None), (UNKNOWN, None, None)]
LEGACY_BANDS = {
    "under_50": ["under_30", "30_35", "35_40", "40_45", "45_50"],
    "under_50万": ["under_30", "30_35", "35_40", "40_45", "45_50"],
    "50_60": ["50_55", "55_60"],
    "60_70": ["60_65", "65_70"],
    "70_80": ["70_75", "75_80"],
    "80_over": ["80_85", "85_90", "90_95", "95_100", "100_105", "105_110", "110_115", "115_120", "120_over"],
    "over_80": ["80_85", "85_90", "90_95", "95_100", "100_105", "105_110", "110_115", "115_120", "120_over"],
}
WORK_STYLES = ["ONSITE", "HYBRID", "REMOTE", "FULL_REMOTE", "UNKNOWN"]
CONTRACT_TYPES = ["SEMI_DELEGATION", "DISPATCH", "CONTRACT", "OTHER", "UNKNOWN"]
SKILL_TYPES = ["REQUIRED", "PREFERRED", "USED_TECHNOLOGY"]
SKILL_ALIASES = {
    "java": "Java",
    "javascript": "JavaScript",
    "js": "JavaScript",
    "typescript": "TypeScript",
    "ts": "TypeScript",
    "aws": "AWS",
    "amazonwebservices": "AWS",
    "amazon web services": "AWS",
    "react": "React",
    "reactjs": "React",
    "react.js": "React",
    "python": "Python",
    "php": "PHP",
}
REGIONS = {
    "東京": ["東京", "東京都", "渋谷", "新宿", "品川"],
    "大阪": ["大阪", "大阪府", "梅田", "淀屋橋"],
    "愛知": ["愛知", "名古屋"],
    "福岡": ["福岡", "博多"],
    "神奈川": ["神奈川", "横浜", "川崎"],
    "千葉": ["千葉"],
    "埼玉": ["埼玉"],
}
WORK_STYLE_WORDS = {
    "FULL_REMOTE": ["full remote", "full_remote", "フルリモート", "完全リモート"],
    "HYBRID": ["一部リモート", "週2出社", "週3出社", "ハイブリッド", "hybrid"],
    "REMOTE": ["リモート可", "リモート中心", "remote", "リモート"],
    "ONSITE": ["常駐", "出社", "オンサイト", "onsite"],
}
CONTRACT_WORDS = {
    "SEMI_DELEGATION": ["準委任", "semi"],
    "DISPATCH": ["派遣", "dispatch"],
    "CONTRACT": ["請負", "contract"],
    "OTHER": ["業務委託", "outsourc"],
}
RANKING_LIMIT = 50
#: Alert codes with severity and target.
ALERTS = {
    "PROJECT_SKILL_MISSING": ("critical", "project"),
    "PROJECT_PRICE_MISSING": ("warning", "project"),
    "PROJECT_REGION_MISSING": ("warning", "project"),
    "PROJECT_WORK_STYLE_UNKNOWN": ("info", "project"),
    "PROJECT_START_MONTH_MISSING": ("info", "project"),
    "NEEDS_REVIEW": ("warning", "both"),
    "PERSON_SKILL_MISSING": ("critical", "person"),
    "PERSON_PRICE_MISSING": ("warning", "person"),
    "PERSON_REGION_MISSING": ("warning", "person"),
    "PERSON_WORK_STYLE_UNKNOWN": ("info", "person"),
}
