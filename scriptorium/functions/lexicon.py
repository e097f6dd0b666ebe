"""Word lists, patterns and weights of the style analysis.

Patterns are written for Java's regular expressions and are read without regard to
letter case unless a comment says otherwise.
"""

# --- words and sentences -------------------------------------------------------------
W1 = r"\b[\w’'-]+\b"
W2 = r"\b[A-Za-z][A-Za-z’'-]*\b"
W3 = r"[A-Za-z][A-Za-z'-]*"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=(?:[A-Z\[]|\*\*))"
LINE_BREAK = "\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029"
SENTENCE_END = r"[.!?][\]\)\"'’”]*$"

# --- sentence scorer -----------------------------------------------------------------
VOCABULARY = (
    "delve", "leverage", "utilize", "robust", "comprehensive", "streamline", "foster", "facilitate",
    "pivotal", "nuanced", "notable", "notably", "enduring", "garner", "multifaceted",
    "in the realm of", "the landscape of", "a myriad of", "a plethora of", "it is worth noting",
    "it is important to note",
)
HEDGES = (
    r"\boften\b", r"\bgenerally\b", r"\btypically\b", r"\bin many cases\b", r"\bit can be argued\b",
    r"\bit is important to note(?: that)?\b", r"\bit is worth mentioning\b", r"\bone might consider\b",
    r"\bmay result in\b", r"\bcan often lead to\b", r"\btends? to\b",
)
TRANSITIONS_STRONG = (
    r"^\s*Furthermore,", r"^\s*Moreover,", r"^\s*Additionally,", r"\bIt is clear that\b",
    r"\bThis (?:highlights|underscores|demonstrates) the importance of\b", r"\bAs previously mentioned\b",
    r"\bIn addition to the above\b", r"\bIt goes without saying\b", r"\bNeedless to say\b",
)
TRANSITIONS_MODERATE = (
    r"^\s*Therefore,", r"\bturns out\b", r"\bit turns out that\b", r"\bThe standard fix is\b",
    r"\bThe common approach is\b", r"\bSimple enough on paper\b", r"\bThe rule I use\b",
    r"\bThe key insight\b", r"\bThe approach here\b", r"\bThe other thing I(?:'|’)d say\b",
    r"\bThe pattern is almost always the same\b",
)
SETUP = (
    r"\b(?:What I didn(?:'|’)t expect was|What surprised me was|The thing I realized was|What it didn(?:'|’)t have was|"
    r"What ended up working was|What changed everything was|What finally clicked was|What made the difference was)\b"
)
DIMINISHMENT = r"\b(?:not just\b.{0,80}\bbut\b|not\b.{1,80},\s*it(?:'|’)s\b|not\b.{1,80}\bbut\b)"
MORE_THAN = r"\bmore\s+[A-Za-z'-]+\s+than\s+[A-Za-z'-]+\b"
TURNS_OUT = r"\b(?:turns out|it turns out that)\b"
BINARY = r"\beither\b.{1,100}\bor\b"
BINARY_CHOICE = r"\b(?:choice|choose|choosing|option|options|trade-?off)\b.{0,45}\bbetween\b.{1,90}\band\b"
ACTUAL_WORK = r"\bis the (?:actual|real) work\b"
THESIS_FIRST = r"^(?:.{0,70}\bis the (?:easy|hard) part\b|.{0,80}\bhas become increasingly important\b)"
OBSCURED = r"\b(?:it has been found that|research suggests|it is believed that|it is widely accepted that)\b"
UNIVERSAL = r"\b(?:teams|developers|organizations|institutions|researchers|students) (?:often|frequently|generally|typically)\b"
ANNOUNCEMENT = (
    r"\b(?:the pattern is (?:almost always|always|usually|typically|clear|simple|the same)|"
    r"the rule is|the key point is|the key insight is|what (?:I|we|it)[^.!?]{0,60} was)\b"
)
REFRAME = r"^(?:Laid out|Arranged|Seen|Viewed|Framed|Read|Presented)\s+(?:this way|that way|in this way|in these terms|in a [^,]{1,35})?,?"
COMPOSED_ASIDE = r"\((?:which|something)\s+I\s+(?:choose to read as|take as|am choosing to interpret as|interpret as)[^)]{0,90}\)"
BALANCED_ASIDES = r"\([^()]{1,70},\s*but\s+[^()]{1,70}\)\s+(?:or|and)\s+\([^()]{1,70},\s*but\s+[^()]{1,70}\)"
QUESTION_LIST = (
    r"\b(?:what|why|how)\b[^,.]{1,60},\s*\b(?:what|why|how)\b[^,.]{1,60},\s*\b(?:what|why|how)\b[^,.]{1,60}"
    r"(?:,\s*\b(?:what|why|how)\b[^,.]{1,60})?"
)
COLON_FRAME = r"\b(?:The problem|The answer|The rule|The key insight|The approach):"
VAGUE_TIME = r"\b(?:recently|currently|nowadays|today(?:'s)?|in recent years|latest|emerging)\b"
YEAR = r"\b(?:19|20)\d{2}\b"
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
CITATION = r"\([^()\n]{0,260}\b(?:19|20)\d{2}[a-z]?\b[^()\n]{0,260}\)"

# --- context of a sentence -----------------------------------------------------------
GENERIC = (
    (r"\bit is important to note(?: that)?\b", "Generic metadiscourse", 18),
    (r"\bit should be noted(?: that)?\b", "Generic metadiscourse", 18),
    (r"\bin today's world\b", "Broad stock opening", 18),
    (r"\bdelve into\b", "Inflated stock wording", 14),
    (r"\bplays? a crucial role\b", "Generic evaluative phrase", 14),
    (r"\bvarious factors\b", "Vague noun phrase", 12),
    (r"\bthis highlights the importance\b", "Predictable conclusion frame", 16),
    (r"\bthis study aims to contribute\b", "Formulaic study claim", 16),
    (r"\bfrom the foregoing\b", "Formulaic transition", 15),
    (r"\bthe above discussion shows\b", "Formulaic summary", 15),
    (r"\btaken together\b", "Repeated synthesis frame", 9),
    (r"\bnot only\b.+?\bbut also\b", "Balanced template construction", 10),
)
CONNECTOR = (
    r"^(Moreover|Furthermore|Additionally|In addition|Besides this|Importantly|"
    r"Consequently|Therefore|Thus|Hence|Taken together|Against this background)\b"
)
TRANSITION_WORDS = (
    r"\b(Moreover|Furthermore|Additionally|In addition|Besides this|Importantly|Consequently|Therefore|Thus|Hence|"
    r"Taken together|Against this background|In summary|In conclusion|Overall|Notably|It is worth noting)\b"
)
FRAMES = ("the study", "this study", "the chapter", "this chapter", "in this context", "within this context", "taken together", "rather than")
STYLE_FRAMES = (*FRAMES[:7], "not only", FRAMES[7])
VAGUE_TIME_WIDE = r"\b(recently|currently|nowadays|today(?:'s)?|in recent years|in modern times|contemporary|latest|emerging)\b"
CERTAINTY = r"\b(clearly|obviously|undoubtedly|certainly|proves?|guarantees?|always|never|all|none)\b"
UNSUPPORTED = r"\b(studies show|research shows|evidence shows|it has been proven|scholars agree|experts agree)\b"
IMPLAUSIBLE_PERCENT = r"(?<![\w.])(1[0-9]{2,}|[2-9]\d{2,})(?:\.\d+)?%"
P_VALUE = r"\bp\s*[<=>]\s*(-?\d+(?:\.\d+)?)"
COEFFICIENT = r"\b(?:r|rho|β|beta)\s*=\s*(-?\d+(?:\.\d+)?)"
TYPO = r"(\bteh\b|\brecieve\b|\boccured\b|\bseperate\b|\bdefinately\b|\s{2,}|\s+[,.!?;:]|[,.!?;:]{2,}|[a-z][.!?][A-Z])"

COMMON_TOKENS = (
    "the and of to in that this is are was were with for as by it on from at an be or which can may also such these "
    "those therefore however moreover furthermore additionally overall significant important"
).split()
STOPWORDS = COMMON_TOKENS + (
    "a about above after all also among an any because been before being between both but during each has have having "
    "into its more most not only other over same should than their them then there through under using when where while "
    "who whose will within without would"
).split()

# --- structure -----------------------------------------------------------------------
PROTECTED_LINE = (
    r"^(?:#{1,6}\s+.+|CHAPTER\s+(?:\d+|[A-Z]+)(?:\s+.+)?|"
    r"\d+\.\d+(?:\.\d+){0,3}\s+[A-Z][^\n]{1,150}|"
    r"(?:References|Bibliography|Appendix|Appendices)\b.*)$"
)
SECTION_HEADING = (
    r"^(?:\d+(?:\.\d+){0,3}\.?\s+)?(?:"
    r"abstract|executive summary|introduction|background|literature review|conceptual framework|"
    r"materials? and methods?|methodology|methods?|data and methods?|results?|findings?|"
    r"discussion|integrated discussion|results and discussion|discussion and recommendations?|"
    r"conclusion|conclusions|limitations|recommendations?|references|works cited|bibliography|appendix|appendices)\b"
)
SECTION_NUMBER = r"^\d+(?:\.\d+){0,3}\.?\s+"
#: In this order the first that a heading starts with names its section.
SECTIONS = (
    ("abstract", ("abstract", "executive summary")),
    ("methods", ("materials", "methodology", "method", "data and method")),
    ("discussion", ("results and discussion", "discussion", "integrated discussion")),
    ("results", ("result", "finding")),
    ("references", ("references", "works cited", "bibliography")),
    ("appendix", ("appendix", "appendices")),
    ("conclusion", ("conclusion", "recommendation", "limitation")),
    ("intro_lit", ("introduction", "background", "literature review", "conceptual framework")),
)
PROFILE_SECTIONS = ("abstract", "intro_lit", "methods", "results", "discussion", "conclusion", "other")
CAPTION = r"^(?:Table|Figure|Fig\.?|Appendix)\s+\d*[A-Za-z]?[.:]?\b"
CAPTION_STRICT = r"^(?:Table|Figure|Appendix)\s+\d+[A-Za-z]?[.:]?\s"
NUMBERED_HEADING = r"^\d+(?:\.\d+){0,3}\s+[A-Z]"  # letter case counts
NUMBERED_TITLE = r"^\d+(?:\.\d+){0,3}\s+[A-Z][A-Za-z]"  # letter case counts
BARE_HEADING = r"^(?:Abstract|Executive Summary|Introduction|Conclusion|Recommendations?|Limitations?|References|Works Cited|Bibliography)$"
FORM_LABEL = r"^(?:FULL LEGAL NAME|LOCATION|EMAIL ADDRESS|Team member\s+\d+)\b"
FORM_START = r"^(?:FULL LEGAL NAME|LOCATION|EMAIL ADDRESS|Team member\s+\d+|Works Cited|References|Bibliography)\b"
INSTITUTION = r"\b(?:University|Department|School|College|Institute|Faculty|Centre|Center)\b"
AUXILIARY = r"\b(?:is|are|was|were|has|have|can|may|will|should)\b"
NUMERIC_TOKEN = r"^(?:[-+<>]?\d+(?:\.\d+)?%?|[A-Z]{2,6}|\.?\d{3,})$"  # letter case counts
REPORT_OPENING = r"^(?:This study|This paper|The study|The paper|The results|The findings|The analysis|This result|This pattern|The distinction)\b"

# --- document families ---------------------------------------------------------------
FAMILY_WEIGHTS = {"A": 1.0, "B": 1.0, "C": 0.75, "D": 0.85, "E": 0.85, "F": 1.0, "G": 1.0, "H": 0.75, "I": 0.60}
FAMILY_NAMES = {
    "A": "Perplexity", "B": "Burstiness", "C": "Hedge density", "D": "Structural tells", "E": "Specificity",
    "F": "Transitions", "G": "Punctuation", "H": "Voice / register", "I": "Rhetorical scaffolding",
}
GENERIC_ADJECTIVE = r"\b(?:significant|notable|key|important)\s+(?:improvements?|progress|challenges?|issues?|factors?)\b"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"
CONCLUSION_OPENER = r"(?:^|\n)\s*(?:In conclusion|To summarize|In summary)\b"
PAIRED_DASHES = r"—[^—\n]{1,120}—"
INFORMAL = r"\b(?:lmk|btw|imo|fyi)\b|~\d+%|<\d+\s*(?:min|mins|minutes)"
SELF_CORRECTION = r"\b(?:wait[,—-]|I mean[,—-]|that(?:'|’)s not quite right|no,? that(?:'|’)s not)\b"
DATED_DETAIL = (
    r"\b(?:I|we)\b.{0,90}\b(?:on|in|during)\s+(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|"
    r"March|April|May|June|July|August|September|October|November|December|\d{1,2}\s+[A-Z][a-z]+)\b"
)
METHOD_TERMS = (
    r"\b(?:Friedman|Wilcoxon|Kendall(?:'s)?\s+W|latent class analysis|LCA|Cram[eé]r(?:'s)?\s+V|chi-square|p\s*[<=>]|AIC|BIC|"
    r"entropy|StepMix|SciPy|NumPy)\b"
)
EXACT_PERCENT = r"\b\d+(?:\.\d+)?%\b"
P_STATEMENT = r"\bp\s*[<=>]\s*\d"
DATA_SOURCES = r"\b(?:World Bank|Global Public Procurement Database|GPPD|OECD|Yahoo Finance|Kenneth French)\b"

#: Reasons that contain one of the markers belong to the family.
REASON_FAMILIES = (
    ("A", ("predictable", "vocabulary", "generic evaluative", "inflated stock", "generic metadiscourse")),
    ("B", ("rhythm", "sentence-length", "very long sentence", "very short sentence", "cadence")),
    ("C", ("hedge", "softening", "uncertainty")),
    ("D", ("structural", "three-part", "paragraph opening", "sentence opening", "balanced template")),
    ("E", ("specificity", "obscured actor", "unsupported", "broad evidence claim")),
    ("F", ("transition", "connector", "formulaic summary", "synthesis frame")),
    ("G", ("em-dash", "semicolon", "punctuation", "colon pattern", "clause density")),
    ("H", ("voice", "register", "professional voice")),
    ("I", ("rhetorical", "scaffolding", "announcement", "pivot", "repeated frame", "parallel question", "thesis/landing")),
)

# --- style of the whole text ---------------------------------------------------------
DIRECT_VERB = (
    r"\b(we|they|the researchers|the authors|the team)\s+(?:conducted|performed|carried out)\s+"
    r"(an analysis of|an examination of|an evaluation of)\s+"
)
STYLE_GENERIC = (
    DIRECT_VERB, r"\bin today's world\b", r"\bit is important to note\b", r"\bit should be noted\b", r"\bdelve into\b",
    r"\bplays a crucial role\b", r"\bvarious factors\b", r"\bthis highlights the importance\b", r"\bthis study aims to contribute\b",
    r"\bthe research problem is that\b", r"\bthat matters\b", r"\bthis qualification matters\b", r"\bit is against this background that\b",
    r"\bit can therefore be said that\b", r"\bfrom the foregoing\b", r"\bthe above discussion shows\b", r"\bthe foregoing discussion\b",
    r"\bneedless to say\b", r"\bthe study is important in\b", r"\bthe study can show how\b", r"\bit is clear that\b",
    r"\bit is evident that\b", r"\bit is worth noting\b", r"\bin the realm of\b", r"\ba myriad of\b", r"\ba plethora of\b",
    r"\butili[sz]e\b", r"\bmultifaceted\b", r"\bthis (?:highlights|underscores|demonstrates) the importance\b",
    r"\bthe present assignment\b", r"\bthe present analysis\b", r"\bthe present report\b",
)
LINE_CONNECTOR = r"(?m)^\s*(?:Moreover|Furthermore|Additionally|In addition|Taken together)\s*,"
OPENING_MARKS = r"^[\s\"'“”‘’(\[{]+"

# --- protected evidence --------------------------------------------------------------
HEADING_LINE = (
    r"^[ \t]*(?:#{1,6}\s+.+|CHAPTER\s+(?:\d+|[A-Z]+)(?:\s+.+)?|\d+(?:\.\d+){0,3}[.)]?\s+[A-Z][^\n]{1,150}|"
    r"(?:Executive Summary|Abstract|Introduction|Conclusion|Recommendations?|Limitations?|References|Works Cited|Bibliography))[ \t]*$"
)
REFERENCE_HEADING = r"^(?:#{1,6}\s*)?(?:References|Works Cited|Bibliography|Source Use Audit|Appendix|Appendices)\b"
FORM_LINE = (
    r"^(?:FULL LEGAL NAME|LOCATION(?: \(COUNTRY\))?|EMAIL ADDRESS|MARK X|Team member\s+\d+|Statement of integrity|"
    r"Use the box below|Note:|N/A\b)"
)
FIGURE_LINE = r"^(?:Table|Figure)\s+\d+[A-Za-z]?[.:]?\s"
EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
EQUATION = (
    r"\b(?:pi|tau|alpha|beta|delta|sigma|[A-Za-zπΣΔ][A-Za-z0-9_πΣΔ]*)\s*=\s*(?:[-+]?\d+(?:\.\d+)?|"
    r"[A-Za-zπΣΔ][A-Za-z0-9_πΣΔ]*(?:\s+[A-Za-zπΣΔ][A-Za-z0-9_πΣΔ]*){0,5})"
)
#: name -> (pattern, whether letter case counts); the order is that of reported changes.
EVIDENCE = {
    "headings": ("(?m)" + HEADING_LINE, False),
    "years": (r"\b(?:19|20)\d{2}[a-z]?\b", False),
    "numbers": (r"(?<![A-Za-z])(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?:%|\b)", True),
    "placeholders": (r"\[[^\]\n]+\]", True),
    "urls": (r"https?://\S+|\bdoi:\s*\S+|\b10\.\d{4,9}/\S+", False),
    "citation_blocks": (CITATION, False),
    "numbered_items": (r"(?m)^\s*\d+[.)]\s+[^\n]+$", True),
    "display_equations": (r"(?s)\$\$.*?\$\$", True),
    "table_lines": (r"(?m)^\s*\|[^\n]+\|\s*$", True),
    "tabular_lines": (r"(?m)^[^\n]*(?:\t|\s\|\s)[^\n]*$", True),
    "emails": (EMAIL, False),
    "reference_headings": ("(?m)^[^\\S\\n]*" + REFERENCE_HEADING[1:] + "[^\\n]*$", False),
    "equationish": (EQUATION, False),
    "acronyms": (r"\b[A-Z]{2,10}(?:_[A-Z0-9]+)?\b", True),
}
QUALIFIERS = {
    "negation": r"\b(?:not(?!\s+(?:only|simply|merely)\b)|never|neither|nor|without|no)\b|n['’]t\b",
    "possibility": r"\b(?:may|might|could)\b",
    "obligation": r"\b(?:must|should)\b",
    "intention": r"\b(?:aims?|aimed|seeks?|sought|intends?|intended)\s+to\b",
}
