"""Word lists, patterns and constants that results depend on."""

# Words that are never index or query terms.
STOPWORDS = (
    "a an and are as at be been but by for from had has have he her his i if in into is it its "
    "of on or she so such than that the their them then there these they this those to was "
    "were what when where which who whom will with would"
).split()

# Words of a question that say how it is asked, not what to find.
QUERY_STOPWORDS = (
    "what does did do how has have is are was were provide provides provided say says said mean means meaning explain "
    "describe tell about under regarding concerning according article articles art arts constitution constitutional "
    "india indian supreme court courts interpret interpreted interpretation held hold holds decide decided decision "
    "establish established significance significant case cases judgment judgments law laws "
    "argue argued argues arguing argument arguments contend contended contention can could would should may might must "
    "will shall not no yes any some there their them they it its this that these those which who whom whose when where "
    "why whether also than then very against down up away took take taken give given lay laid put get got make made "
    "apply applies applied"
).split()

# Parts of names that identify no case.
GENERIC_NAME_TOKENS = (
    "his holiness and ors anr others another etc the of ltd limited state states union india dead lrs by through thr "
    "secretary ministry law justice government govt citizens welfare forum industries mills foundation company society "
    "association council board corporation co pvt private public commissioner director collector"
).split()

# Abbreviations that end no sentence.
ABBREVIATIONS = (
    "v vs no nos art arts s ss cl cls sub j jj cj cji c ors anr etc viz ie eg p pp para paras sec secs mr ms mrs dr "
    "hon'ble ltd co govt supp scr scc air vol ch sch"
).split()

# Words of a claim that cannot be checked; stop words and negators count too.
GENERIC_CLAIM_WORDS = (
    "article articles art constitution court courts supreme judgment judgments case cases held holds hold "
    "observed noted stated provides provide provided provision says said read reads interpreted interprets "
    "interpretation according evidence passage passages suggest suggests suggested together also therefore thus "
    "may must shall can could should would will does did do one any every whether per which while because "
    "under within upon about later earlier further first second"
).split()

# Capitalised words that are no names.
GENERIC_CAPITALIZED = (
    "the a an in on this that these those it its article articles constitution court supreme high india indian state "
    "states union parliament government justice part schedule section clause act bench judgment petitioner respondent "
    "however read together thus also both such further according under every any all no"
).split()

NEGATORS = ["not", "no", "never", "cannot", "nothing", "none", "neither", "nor"]
ANTONYMS = [
    (["valid"], ["invalid", "void"]),
    (["constitutional"], ["unconstitutional", "ultra"]),
    (["upheld", "uphold", "upholds"], ["struck", "strike", "quashed", "invalidated"]),
    (["permitted", "permissible", "allowed", "lawful", "legal"], ["prohibited", "impermissible", "forbidden", "unlawful", "illegal"]),
]
ABSOLUTE = ["absolute", "unlimited", "unrestricted", "unqualified", "unconditional"]
QUALIFIERS = ["subject to", "reasonable restriction", "except", "restriction"]

# Endings taken off by the light stemmer and by the claim stemmer, in order of trial.
LIGHT_SUFFIXES = ["ing", "ied", "ies", "ed", "es", "s"]
CLAIM_SUFFIXES = ["ations", "ation", "ments", "ment", "ings", "ing", "ions", "ion", "ies", "ied", "ally", "ional", "ural", "ed", "es", "s", "ly"]

# Patterns of references, questions and layout.
REFERENCE = r"\d+[a-z]{0,3}\s?(?:\(\s?[0-9a-z]{1,4}\s?\))+"
FIRST_CLAUSE = r"(\d+[a-z]{0,3}\s?)\(\s?[li]\s?\)(?=\s?\()"
CASE_FORM = r"\b[A-Z][\w.]*(?:\s+[\w.&]+){0,6}\s+(?:v\.|vs\.?|versus)\s+[A-Z]"
ARTICLE_BLOCK = r"\b(?:articles?|arts?\.?)\s+((?:\d{1,3}[A-Za-z]{0,3}(?:\s?\(\s?\w{1,4}\s?\))*(?:\s*,\s*|\s+and\s+|\s*&\s*|\s+or\s+)?)+)"
ARTICLE_NUMBER = r"(\d{1,3}[A-Za-z]{0,3})((?:\s?\(\s?\w{1,4}\s?\))*)"
INTERPRETATION = (
    r"\binterpret\w*|\b(?:court|bench|judges?)\s+(?:has\s+|have\s+)?(?:say|said|says|held|hold|holds|ruled?|rulings?|decided|"
    r"observed|read|construed|explained)\b|\bjudgments?\b|\bjudicial\b|\bcase[- ]law\b|\bprecedents?\b|\bdoctrines?\b|"
    r"\bhow\s+(?:has|have|did)\s+(?:the\s+)?(?:supreme\s+)?courts?\b"
)
PAGE_NUMBER = r"^[\s\-–—]*(?:page\s+)?\d{1,4}(?:\s+of\s+\d{1,4})?[\s\-–—]*$"
SENTENCE_BOUNDARY = r"[.;?!][\"'”’)]*\s+(?=[\"“‘(]?[A-Z0-9])"

# Quotations, what stands for words left out of them, contractions of "not", and words as a speaker says them.
QUOTED = r"“[^”]+”|\"[^\"]+\""
GAP = r"\[?(?:…|\.\.\.)\]?"
NOT_CONTRACTED = r"n['’]t\b"
SPOKEN_WORD = r"[a-z0-9()]+"
NAME_WORD = r"[A-Za-z][\w’'-]*"
GUARD = r"\b(?:except|only)\b(.{0,80})"
INTERPRETIVE = r"\b(?:interpret\w*|held|holds|construed|read|reads|observed|ruled|view)\b"

# Structure of constitutional texts.
LEAD = r"(?:\d{0,2}\s?\[)?\*{0,3}"
ARTICLE = LEAD + r"(\d{1,3}[A-Z]{0,3})\.\s+([A-Z(‘'\"].{1,160}?)\.\s*(?:—|–|-{1,2})\s*(.*)$"
OMITTED = LEAD + r"(\d{1,3}[A-Z]{0,3})\.\s*\[([^\]]{2,160}?)\.?\]\s*((?:Rep\.|Omitted|Repealed).*)$"
ARTICLE_START = LEAD + r"\d{1,3}[A-Z]{0,3}\.\s+[A-Z(‘'\"]"
PART = r"PART\s+([IVXLC]+[A-Z]?)\b\.?\s*(?:[—–-]+\s*(\S.*))?$"
CHAPTER = r"CHAPTER\s+([IVXLC]+)\b\.?\s*(?:[—–-]+\s*(\S.*))?$"
SCHEDULE = r"(?:THE\s+)?(?:(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|ELEVENTH|TWELFTH)\s+)?SCHEDULE\b\s*(?:\[.*\])?$|APPENDIX\b.*$"
PREAMBLE = r"PREAMBLE$"
WE_THE_PEOPLE = r"WE,?\s+THE\s+PEOPLE\s+OF\s+INDIA"
CLAUSE = r"(\(\d+[A-Z]?\))\s"
TERMINAL = r"[.;:?!][\"'”’)\]]*$"
NUMBERED_PARAGRAPH = r"\d{1,3}\.\s+[A-Z]"

# Structure of judgments.
DELIVERED = r"judgments?\s+of\s+the\s+court\s+(?:was|were)\s+delivered|following\s+judgments?\s+(?:of\s+the\s+court\s+)?(?:was|were)\s+delivered"
JUDGMENT_TITLE = r"(?:J\s*U\s*D\s*G\s*M\s*E\s*N\s*T|O\s*R\s*D\s*E\s*R)$"
AUTHOR = r"(?:DELIVERED\s+BY\s+)?((?:[A-Z]\.\s?){0,4}[A-Z][A-Z'’-]+(?:\s+[A-Z][A-Z'’-]+){0,2},\s*(?:C\.?J\.?I\.?|C\.?\s?J\.|J\.))(?=\s|$)"
HEADING_WORDS = (
    r"(?:(?:[A-Z]|[IVXLC]{1,6}|\d{1,2})[.)]\s+|\((?:[a-z]|[ivx]{1,5}|\d{1,2})\)\s+)?"
    r"(?:brief\s+facts|facts|factual\s+(?:background|matrix)|background|introduction|preface"
    r"|issues?|questions?\s+(?:of\s+law|for|involved|arising)|points?\s+(?:for|of)\s+(?:consideration|determination)"
    r"|submissions?|arguments?|contentions?|rival\s+(?:submissions|contentions)|analysis|discussion"
    r"|consideration|reasoning|findings?|conclusions?|summary|held|order|final\s+order|directions?"
    r"|guidelines|relief|disposition|epilogue|the\s+law|legal\s+position|precedents)\b"
)
INLINE_HEADING = r"(HELD|FACTS|ISSUES?|ORDER|CONCLUSIONS?|DIRECTIONS)\s*[:—–]\s*\S"

# Evidence markers of generated answers.
MARKER = r"\[\s*E\d+(?:\s*[,;]\s*E?\d+)*\s*\]"
ELLIPSIS = " […] "
