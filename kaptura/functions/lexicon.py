"""Word lists, character sets and tables that results depend on."""

from __future__ import annotations

# Words that cling to the word before them and never begin a line.
BOUND_PARTICLES = ("的", "了", "着", "得", "地", "过", "们", "的话", "们的")
BOUND_CLASSIFIERS = ("个", "种", "份", "点", "条", "本", "层", "位", "线", "度", "张", "把", "支", "届", "款")
# The particle 得 is a verb, and free, before one of these.
MODAL_FOLLOWERS = "去要重新想想做把将"

# Words that leave a phrase open at the end of a line.
OPEN_PREPOSITIONS = ("在", "把", "被", "将", "按", "从", "向", "往", "跟", "同", "由", "与")
OPEN_COMPOUNDS = ("处于", "位于", "基于", "鉴于", "关于", "对于")

DISCOURSE_MARKERS = ("好", "好的", "OK", "ok", "那么", "所以", "呃", "那", "对", "行")

# Words that begin a new thought, in the order in which they are tried.
CONNECTORS = ("总的来说", "换句话说", "也就是说", "接下来", "另一方面", "然后", "但是", "所以", "那么", "而且", "另外", "并且", "其实", "因为", "由于", "比如", "不过", "然而", "如果", "虽然", "接着", "首先", "其次", "最后", "与此同时")
# The character-based segmenter knows all but the last of them.
CLASSIC_CONNECTORS = CONNECTORS[:-1]

TAG_QUESTIONS = ("对吧", "对不对", "是不是", "是吧", "好不好", "OK吗", "ok吗", "行不行", "懂了吧", "对吗", "行吧", "可以吧", "能理解吧", "能明白吧", "是这样吧")

MODAL_ENDINGS = "啊呢吧呀哦哈啦喽么"
ORDINAL_HEADS = ("第", "每", "上", "下", "前", "后")
LINKING_VERBS = ("是", "为", "叫", "有", "包括")
DETERMINERS = ("这个", "那个", "一种", "这种", "某个")
NUMBER_WORDS = ("四", "八", "十六", "三十二", "三百")
COUNTED_UNITS = ("个", "比特", "字节", "分贝", "兆", "兆赫", "公斤", "斤")

SENTENCE_ENDS = "？。！?!"
CLAUSE_ENDS = "，、；：,;"
WIDE_PUNCTUATION = "，。？！、；：“”‘’《》（）…—"

# The character-based segmenter's breaks and what is stripped off its lines.
HARD_BREAKS = "。！？!?\n"
SOFT_BREAKS = "，,;；、:"
OUTER_PUNCTUATION = "，。、；：·\"' 　\n.,;:"
SPLIT_LEADERS = ("以及", "关于", "并且", "其中", "如果", "那么", "而且", "或者", "但是", "对于", "通过", "此时", "包括", "同时", "从而", "为了", "所以", "因为", "另外", "接下来")
SPLIT_TRAILERS = ("的", "了", "呢", "吧", "啊", "吗", "呀", "哦", "中", "后", "上", "完", "过")

# Spoken digits and magnitudes.
CN_DIGITS = {"零": "0", "〇": "0", "一": "1", "幺": "1", "二": "2", "两": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}
CN_TENS = {"十": 10, "百": 100, "千": 1000}
CN_MYRIADS = {"万": 10_000, "亿": 100_000_000}
CN_NUMERALS = "零〇一二三四五六七八九十百千万亿两幺"
UNITS = (
    "微秒", "毫秒", "纳秒", "皮秒", "秒", "分钟", "小时", "字节", "比特", "位", "帧", "兆", "吉", "赫兹", "米", "公里", "千米", "厘米",
    "毫米", "瓦", "伏", "安", "欧", "分贝", "倍", "Mbps", "Kbps", "Gbps", "MB", "KB", "GB", "TB", "Bit", "bit",
    "Byte", "byte", "Hz", "KHz", "MHz", "GHz", "ms", "us", "ns", "dB", "W", "V", "A", "B",
)

# Acronyms with a fixed way of writing: those with a separator, and common ones as they stand.
ACRONYMS = {
    "TCPIP": "TCP/IP", "ACDC": "AC/DC", "AB": "A/B", "YNY": "Y/N", "PL": "P/L", "HTTP": "HTTP",
    "HTTPS": "HTTPS", "FTP": "FTP", "DNS": "DNS", "DHCP": "DHCP", "NAT": "NAT", "VPN": "VPN", "CPU": "CPU",
    "GPU": "GPU", "RAM": "RAM", "ROM": "ROM", "OS": "OS", "DB": "DB", "API": "API", "SDK": "SDK",
    "IDE": "IDE", "PDF": "PDF", "URL": "URL", "URI": "URI", "USB": "USB", "HDMI": "HDMI", "SSD": "SSD",
    "HDD": "HDD", "LCD": "LCD", "LED": "LED", "GPS": "GPS", "NFC": "NFC", "AI": "AI", "ML": "ML", "DL": "DL",
    "CV": "CV", "NLP": "NLP", "ID": "ID", "OK": "OK",
}

# What the guard takes for numerals and units, by variant.
GUARD_CN_UNITS = {
    "service": "零〇一幺二两三四五六七八九十百千万亿点.分之兆千百十微毫纳皮秒分时天米克伏安欧瓦赫赫兹摩尔",
    "cli": "零〇一幺二两三四五六七八九十百千万亿点分之千兆微毫纳皮秒分时天米克升摩尔赫兹欧姆伏安瓦特焦耳牛顿帕斯卡分贝字节比特元度个条把张次倍",
}
GUARD_LATIN_UNITS = {
    "service": "0123456789. %/kMGTmupnsdhvkAVWHzmolL",
    "cli": "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.+-*/^%μΩ° ",
}
# What the guard leaves out when it compares, as the inside of a character class.
GUARD_PUNCTUATION = {
    "service": r"""\s,，.。、；;：:!！?？"'“”‘’()（）\[\]【】《》<>—\-…~～/\\_#@*&^%+=|`""",
    "cli": r"""\s,，.。、；;：:!！?？"'“”‘’()（）\[\]【】《》<>—\-…~～/\\·・""",
}
INITIALS = ("zh", "ch", "sh", *"bpmfdtnlgkhjqxzcsryw")
CONFUSABLE_INITIALS = (("b", "p"), ("d", "t"), ("g", "k"), ("j", "q", "x"), ("z", "c", "s"), ("zh", "ch", "sh", "r"), ("f", "h"), ("l", "n", "r"))

MEDIA_EXTENSIONS = (".mp4", ".avi", ".mkv", ".mov", ".webm", ".flv", ".wmv", ".m4v", ".mpg", ".mpeg", ".ts", ".mts", ".m2ts", ".3gp", ".mp3", ".wav", ".m4a", ".aac", ".flac", ".ogg", ".wma")
IGNORED_FOLDERS = (".venv", ".git", "__pycache__", "node_modules", ".cache", ".gemini", ".system_generated", "@eaDir", "$RECYCLE.BIN", "System Volume Information", ".DS_Store")
