"""Fixed values that ranking and shaping depend on; each is needed as it stands for right results."""

SECTIONS = ("summary", "diagnosis", "clinical_features", "management", "genetic_counseling", "molecular_genetics", "resources", "other", "references")

SECTION_PRIORITY = {
    "summary": 0,
    "diagnosis": 0,
    "clinical_features": 1,
    "management": 1,
    "genetic_counseling": 2,
    "molecular_genetics": 2,
    "resources": 5,
    "other": 7,
    "references": 50,
}
UNKNOWN_PRIORITY = 100
GUARDED = ("references",)

ROLES = ("evidence", "cross_reference", "definition", "table_caption", "table_body")
ROLE_WEIGHT = {"cross_reference": 0.4, "evidence": 1.0, "definition": 0.95, "table_caption": 0.85, "table_body": 1.0}
PRIMARY_BOOST = 1.25
RRF_K = 60

#: Intent: what a query must contain, and what each section then gains.
INTENTS = {
    "management": (("treatment", "management", "therapy", "surgery", "prophylactic", "risk-reducing", "screening", "surveillance", "intervention", "prevent", "prevention", "managing"), {"management": 0.30}),
    "diagnosis": (("diagnosis", "diagnostic criteria", "establishing", "confirming", "differential", "differential diagnosis"), {"diagnosis": 0.30, "clinical_features": 0.10}),
    "genetics": (("inheritance", "penetrance", "autosomal", "x-linked", "variant spectrum", "molecular genetics"), {"molecular_genetics": 0.20, "genetic_counseling": 0.05}),
}

STOP_WORDS = ("a", "an", "the", "and", "or", "of", "in", "is", "it", "to", "for", "on", "at", "be", "as", "by", "do", "up", "if", "no", "so", "we", "he", "she", "they", "you", "our", "are", "was", "not", "but", "has", "had", "its", "can", "may", "who", "how", "all", "one", "two")

#: Section rules: the first pattern that a title matches, letters in either case.
SECTION_RULES = (
    (r"^\s*summary\b", "summary"),
    (r"^\s*references?\b", "references"),
    (r"^\s*resources\b", "resources"),
    (r"genetic\s+counsel", "genetic_counseling"),
    (r"molecular\s+genetics", "molecular_genetics"),
    (r"pathogenic\s+variants?", "molecular_genetics"),
    (r"differential\s+diagnos", "clinical_features"),
    (r"clinical\s+(description|characteristics|features)", "clinical_features"),
    (r"diagnos", "diagnosis"),
    (r"^\s*(treatment|surveillance|management|therapy|prevention)\b", "management"),
)

CROSS_REFERENCE_HEADINGS = ("Related", "Issues", "Counseling", "Information", "Evaluation of Relatives at Risk", "GeneReview Scope")
CROSS_REFERENCE_PHRASES = ("refer to ", "for details", "for more information", "described in")
NOMENCLATURE_PHRASES = (r"is an? synonym of", r"is an? historical name for", r"has also been referred to as", r"was initially named", r"was previously referred to as")

#: Patterns of texts, titles, references and dates that decide results.
HTML_TAG = r"<[^>]+>"
HTML_ENTITY = r"&[a-zA-Z0-9#]+;"
ODD_BLANK = r"[\x{a0}\x{2009}\x{202f}]"
DETAILS_LABEL = r"(?i)\s*(Show details|Hide details)\s*"
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
KEY_MARK = r"(?U)[^\w\s-]"
KEY_BLANK = r"(?U)[-\s]+"
KEY_ARTICLE = r"^(the_|a_|an_)"
KEY_KIND = r"(_section|_chapter)$"
REFERENCE_AUTHORS = r"^([^.;]+)"
REFERENCE_QUOTED = r'"([^"]+)"'
REFERENCE_TITLE = r"\.([^.]+)\.\s*[A-Z]"
REFERENCE_JOURNAL = r"\.\s*([A-Z][^.]+?)\.\s*\d{4}"
REFERENCE_JOURNAL_WORDS = r"\b([A-Z][a-z]*\s+[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*)\s*\.\s*\d{4}"
REFERENCE_PMID = r"(?i)PMID:?\s*(\d+)"
REFERENCE_YEAR = r"\b(?:19|20)\d{2}\b"
UPDATE_DATE = r"(?i)\b(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
UPDATE_WORD = r"(?i)updated?|revised?"

#: Code points that may not leave the fence: controls, zero-width and directional marks.
FORBIDDEN = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{200b}-\x{200d}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]"

#: Words that English full-text search leaves out.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split()

#: Fixed values of the published English stemmer: whole words, words left as they are (at once, or after plurals), beginnings that its first region doesn't cut.
STEM_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STEM_INVARIANTS = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
STEM_SINGULARS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEM_BEGINNINGS = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ")

#: Its endings: those of the second, third and fourth step, with what takes their place.
STEM_SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEM_FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
