"""Fixed values that results depend on, and the rules that come with the package."""

from __future__ import annotations

# File extensions and markers, in the order in which they apply.
EXTENSIONS = ["mp4", "avi", "mkv", "wmv", "mov", "flv", "m4v", "mpg"]
RESOLUTION = ["UHD1080p", "UHD720p", "FHD1080p", "FHD720p", "HD1080p", "HD720p", "HD480p", "HD360p", "2160p", "1080p", "1080P", "720p", "540p", "480p", "360p", "240p", "2160", "1080", "720", "480", "360", "240", "FHD", "4K", "4k", "2K", "2k"]
QUALITY = ["HQ", "UHD", "HD", "SDR"]
SOURCE = ["DVD-RIP", "DVD5-RIP", "DVDRip", "DVDRIP", "dvdrip", "WEBRip", "WEBRIP", "webrip", "WEB-DL", "WEB DL", "WEBDL"]
FORMAT = ["3D-SBS", "3D SBS", "h264", "h265", "x264", "x265", "hevc", "HEVC"]
MISC = ["original size", "(b)", "(t)", "(bt)", "movie"]
#: Class, markers, confidence.
MARKERS = [("resolution", RESOLUTION, 0.95), ("quality", QUALITY, 0.9), ("source", SOURCE, 0.85), ("format", FORMAT, 0.8), ("misc", MISC, 0.75)]

# What is trimmed off either end, as a regex over the pieces that all trimming strings are made of.
AFFIX = r"(?:[. _-]|\(\)|\[\])+"
# Strings that become a dash.
DASHED = ["()", "[]", "- -", "___", "__"]
# Characters replaced one by one; those mapped to nothing are removed.
CHARACTERS = {"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "--", "…": "...", " ": " ", "​": "", "‎": "", "‏": ""}
# Tokens that carry nothing.
JUNK = ["Gay", "gay", "GAY", "Bareback", "bareback", "BAREBACK", "BareBack", "1080p", "1080P", "720p", "720P", "4k", "4K", "h264", "H264", "h265", "H265", "x264", "X264", "x265", "X265", "hevc", "HEVC", "dvdrip", "DVDRIP", "DVDRip", "webrip", "WEBRIP", "WEBRip", "web-dl", "WEB-DL", "WEBDL", "WebDL", "Individual Scenes", "Collection", "Collections", "collection", "collections", "Bundle", "bundle", "MOVIES PACK", "Movies Pack", "movie"]
# Words that no name consists of.
NOT_NAMES = ["scene", "movie", "video", "clip", "episode", "part", "series", "collection", "compilation", "best", "of", "the", "in", "on", "at", "to", "from", "with", "for", "by", "de", "la", "el", "les", "des", "et", "und", "en", "y", "e", "vs", "versus", "presents", "features", "starring", "friends", "and", "bareback", "sweat", "apples", "barefoot", "fisted", "juicy", "sunscreen", "beautiful"]

# Months and date shapes. A shape is (name, regex, group of year, of month, of day); month groups of
# the shapes named in TEXT_MONTHS are names.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
MONTHS = {"jan": "01", "january": "01", "feb": "02", "february": "02", "mar": "03", "march": "03", "apr": "04", "april": "04", "may": "05", "jun": "06", "june": "06", "jul": "07", "july": "07", "aug": "08", "august": "08", "sep": "09", "september": "09", "oct": "10", "october": "10", "nov": "11", "november": "11", "dec": "12", "december": "12"}
_Y, _M, _D, _O = r"((?:19|20)\d{2})", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])", r"([0-3]?\d)(?:st|nd|rd|th)?"
DATE_SHAPES = [
    ("iso", rf"{_Y}[-.\s_/]{_M}[-.\s_/]{_D}", 1, 2, 3),
    ("day_month_year", rf"{_O}[\s_.-]+({MONTH})[\s_.,\-]+{_Y}", 3, 2, 1),
    ("parenthesized_month_day_year", rf"\(({MONTH})\s*{_O}[,\s._-]+{_Y}\)", 3, 1, 2),
    ("month_day_year", rf"({MONTH})\s*{_O}[,\s._-]+{_Y}", 3, 1, 2),
    ("compact", rf"{_Y}{_M}{_D}", 1, 2, 3),
    ("compact_month_name", rf"{_O}({MONTH}){_Y}", 3, 2, 1),
    ("us_date", rf"{_M}[./-]{_D}[./-]{_Y}", 3, 1, 2),
    ("year", _Y, 1, 0, 0),
]
TEXT_MONTHS = {"day_month_year", "parenthesized_month_day_year", "month_day_year", "compact_month_name"}

# Code rules, first match first.
CODE_RULES = [
    {"studio": "Corbin Fisher", "code_patterns": ["ACM####", "ACM####-####"], "normalize": {"strip_prefix_letters": True, "strip_leading_zeros": True}, "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": "Active Duty", "code_patterns": ["ACT###", "AD####"], "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": "FratX", "code_patterns": ["FX###"], "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": "Sean Cody", "code_patterns": ["SC####", "SC-####", "SC####-####"], "normalize": {"strip_prefix_letters": True, "strip_leading_zeros": True}, "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": "Scary Fuckers", "code_patterns": ["####_##"], "normalize": {"replace_underscores_with_dash": True}, "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": "Scary Fuckers", "code_patterns": ["(##)### ##"], "normalize": {"normalize_numeric_pair": True}, "studio_relationship": "requires", "allow_suffix": True},
    {"studio": "Boys Halfway House", "code_patterns": ["Incident ###", "Incident \\# ###"], "normalize": {"strip_prefix_letters": True, "strip_leading_zeros": True}, "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": None, "code_patterns": ["MK#######"], "normalize": {"strip_prefix_letters": True, "strip_leading_zeros": True}, "studio_relationship": "can_set", "allow_suffix": True},
    {"studio": None, "code_patterns": ["re:[A-Z]{2,4}[-\\s]?\\d{3,5}"], "studio_relationship": "can_set", "allow_suffix": True},
]
# Alias to canonical studio name.
STUDIO_ALIASES = {"adam & eve": "Adam & Eve Pictures", "adam and eve": "Adam & Eve Pictures"}
# Endings of video files when the best of several files is chosen.
VIDEO_ENDINGS = [".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv"]
# Lines of a text scan that are headings.
SENTINELS = ["exceptions", "sacrifice"]
# The seven fields that evaluation counts.
FIELDS = ["studio", "performers", "date", "studio_code", "title", "sequence", "group"]
