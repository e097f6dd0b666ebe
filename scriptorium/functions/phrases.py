"""Phrases that the rewriter replaces, in order, and the openings it varies.  Letter case of the source is kept."""

ARTEFACTS = (
    r"\s+That is, it matters\.\s*",
    r"\s+That matters\.\s*",
    r"\s+This qualification matters (?:because|insofar as) it keeps the argument tied to the evidence rather than to an unsupported general claim\.\s*",
)
REPLACEMENTS = (
    (r"\bdue to the fact that\b", "because"),
    (r"\bin order to\b", "to"),
    (r"\bfor the purpose of\b", "to"),
    (r"\bwith regard to\b", "regarding"),
    (r"\bthe present investigation\b", "the study"),
    (r"\bthe present study\b", "the study"),
    (r"\bthe current study\b", "the study"),
    (r"\bthe results obtained\b", "the results"),
    (r"\bas an illustration\b", "for example"),
    (r"\bexemplifies how\b", "shows how"),
    (r"\bnon[-\s]trivial function\b", "important role"),
    (r"\bit is important to note that\b", ""),
    (r"\bit should be noted that\b", ""),
    (r"\bin today's world\b", "in the present context"),
    (r"\bdelve into\b", "examine"),
    (r"\bplays a crucial role\b", "is important"),
    (r"\bhas the ability to\b", "can"),
    (r"\bis able to\b", "can"),
    (r"\ba large number of\b", "many"),
    (r"\bit is against this background that\b", "against this background,"),
    (r"\bthe reason for this is because\b", "this is because"),
    (r"\bof particular importance is the fact that\b", "importantly,"),
    (r"\bthe study is important in\b", "the study is useful for"),
    (r"\bit can therefore be said that\b", "therefore,"),
    (r"\bthe above discussion shows that\b", "the discussion shows that"),
    (r"\bthe foregoing discussion shows that\b", "the discussion shows that"),
    (r"\bfrom the foregoing,?\s*\b", ""),
    (r"\bthis highlights the importance of\b", "this points to the importance of"),
    (r"\bit is clear that\b", ""),
    (r"\bit is evident that\b", ""),
    (r"\bit is worth noting that\b", ""),
    (r"\bit is worth mentioning that\b", ""),
    (r"\bin the realm of\b", "in"),
    (r"\ba myriad of\b", "many"),
    (r"\ba plethora of\b", "many"),
    (r"\butili[sz]e\b", "use"),
    (r"\bpivotal role\b", "central role"),
    (r"\bmultifaceted\b", "complex"),
    (r"\bthis (?:highlights|underscores|demonstrates) the importance of\b", "this shows the importance of"),
    (r"\bThis pattern is consistent with\b", "The pattern is consistent with"),
    (r"\bThis result follows from\b", "The result follows from"),
    (r"\bThis result does not establish\b", "The result does not establish"),
    (r"\bThis distinction matters because\b", "The distinction matters because"),
    (r"\bThis stability suggests\b", "The stability suggests"),
    (r"\bThis design distinguishes\b", "The design distinguishes"),
    (r"\bThis choice is applied\b", "The choice is applied"),
    (r"\bThe present assignment\b", "The assignment"),
    (r"\bThe present analysis\b", "The analysis"),
    (r"\bThe present report\b", "The report"),
    (r"\bin nontechnical terms,\s*", "In practical terms, "),
    (r"\bfor faster visual comparison\b", "for easier visual comparison"),
    (r"\bmade use of\b", "used"),
    (r"\bmakes use of\b", "uses"),
    (r"\bmake use of\b", "use"),
    (r"\bon a daily basis\b", "daily"),
    (r"\bin the event that\b", "if"),
    (r"\bduring the course of\b", "during"),
)
DIRECT_VERBS = {"an analysis of": "analysed", "an examination of": "examined", "an evaluation of": "evaluated"}
#: What the signal-guided pass takes out first, and for which families.
GUIDED = (
    ("ACF", r"\b(?:it is important to note that|it is worth noting that|it should be noted that)\s+", ""),
    ("ACF", r"^(?:Furthermore|Moreover|Additionally|In addition|Taken together|Overall),\s+", ""),
    ("ACF", r"\b(?:a myriad of|a plethora of)\b", "many"),
    ("ACF", r"\bin the realm of\b", "in"),
    ("ACF", r"\bthe landscape of\b", "the context of"),
    ("ACF", r"\butilize\b", "use"),
    ("ACF", r"\butilizes\b", "uses"),
    ("ACF", r"\butilized\b", "used"),
    ("ACF", r"\bstreamline\b", "simplify"),
    ("DI", r"\b(?:What (?:this|the) (?:shows|demonstrates) is that)\s+", ""),
)
DASHES = ((r"\s+—\s+([^—\n]{1,120})\s+—\s+", r", \1, "), (r"\s+—\s+", ", "))
CONNECTORS = (
    r"^(Moreover|Furthermore|Additionally|In addition|Besides this|It is also worth noting that|"
    r"Importantly|Consequently|Therefore|Thus|Hence|Taken together|Against this background)\s*,?\s+"
)
DEMONSTRATIVES = ("result", "pattern", "distinction", "stability", "design", "finding", "evidence")
SUBJECTS = (
    r"(?:(?:the|a|an)\s+[A-Za-z][A-Za-z'-]*|this|these|those|it|they|we|researchers|students|institutions|organisations|organizations|"
    r"authors|results|findings|evidence|analysis|study|portfolio|model|simulation|optimiser|optimizer|constraint|allocation)\b"
)
CONTRAST_SUBJECTS = (
    r"(?:(?:the|a|an)\s+[A-Za-z][A-Za-z'-]*|this|these|those|it|they|we|researchers|students|institutions|organisations|organizations|"
    r"authors|results|findings|evidence|analysis|study|convergence|performance|returns|weights|exposure|portfolio|model|simulation|allocation)\b"
)
COLON_SUBJECTS = r"(?:it|they|we|this|these|those|the\s+[A-Za-z][A-Za-z'-]*|a\s+[A-Za-z][A-Za-z'-]*|an\s+[A-Za-z][A-Za-z'-]*)\b"
PIVOT_SUBJECTS = r"(?:the|this|these|those|it|they|we)\b"
PARENTHETICAL_EVIDENCE = r"\([^()\n]{0,260}\d[^()\n]{0,260}\)"
PROPER_NAMES = r"\b[A-Z][a-z]+(?:[-'][A-Za-z]+)?(?:\s+[A-Z][a-z]+(?:[-'][A-Za-z]+)?)+\b"
