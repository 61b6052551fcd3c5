"""Word lists and constants. All of them are defaults of parameters."""

# They have to equal the specification's.
STOPWORDS = {
    "en": ["a", "an", "the", "and", "or", "but", "if", "in", "on", "at", "by", "for", "with", "about"],
    "ru": ["и", "в", "на", "с", "по", "к", "у", "от", "из", "для", "это", "так", "что", "как"],
}
THEORETICAL = {
    "en": ["definition", "concept", "theory", "principle", "defined as", "refers to", "means"],
    "ru": ["определение", "концепция", "теория", "принцип", "определяется как", "означает"],
}
PRACTICAL = {
    "en": ["example", "application", "practice", "how to", "implement", "demonstrate", "let's"],
    "ru": ["пример", "применение", "практика", "как", "реализовать", "показать", "давайте"],
}
INDICATORS = {
    "en": ["important", "essential", "key", "fundamental", "core", "critical", "main"],
    "ru": ["важный", "существенный", "ключевой", "фундаментальный", "основной", "критический"],
}
DOMAIN_KEYWORDS = {
    "en": {
        "mathematics": ["math", "mathematics", "calculus", "algebra", "geometry", "theorem", "equation"],
        "physics": ["physics", "quantum", "mechanics", "energy", "force", "particle", "wave"],
        "programming": ["programming", "code", "algorithm", "function", "class", "object", "data"],
    },
    "ru": {
        "mathematics": ["математика", "алгебра", "геометрия", "теорема", "уравнение"],
        "physics": ["физика", "квантовый", "механика", "энергия", "сила", "частица", "волна"],
        "programming": ["программирование", "код", "алгоритм", "функция", "класс", "объект", "данные"],
    },
}
METADATA_KEYWORDS = {
    "en": {
        "mathematics": ["math", "mathematics", "calculus", "algebra", "geometry", "theorem", "proof", "equation", "function", "derivative", "integral", "statistics", "probability"],
        "programming": ["programming", "algorithm", "code", "software", "development", "computer science", "python", "java", "c++", "javascript", "data structure", "database", "web"],
        "physics": ["physics", "mechanics", "dynamics", "kinematics", "electromagnetism", "thermodynamics", "quantum", "relativity", "force", "energy", "momentum"],
    },
    "ru": {
        "mathematics": ["математика", "матем", "алгебра", "геометрия", "теорема", "доказательство", "уравнение", "функция", "производная", "интеграл", "статистика", "вероятность"],
        "programming": ["программирование", "алгоритм", "код", "программа", "разработка", "информатика", "python", "java", "с++", "javascript", "структура данных", "база данных", "веб"],
        "physics": ["физика", "механика", "динамика", "кинематика", "электромагнетизм", "термодинамика", "квантовая", "относительность", "сила", "энергия", "импульс"],
    },
}
#: Words in a title that add two to a domain's count.
METADATA_BONUS = {"mathematics": "math", "programming": "programming", "physics": "physics"}
#: Terms that a text needs for a concept of the domain to stand in its context.
CONTEXT_TERMS = {
    "physics": [
        "quantum", "mechanics", "energy", "particle", "wave", "field", "relativity", "force", "matter", "momentum", "electron", "photon", "nucleus", "atom", "molecule", "quark",
        "boson", "fermion", "hamiltonian", "lagrangian", "symmetry", "conservation", "entropy", "thermodynamics", "electromagnetism", "nuclear", "radiation",
    ],
    "mathematics": [
        "algebra", "calculus", "geometry", "topology", "function", "theorem", "proof", "equation", "matrix", "vector", "integral", "derivative", "differential", "series",
        "convergence", "set", "group", "ring", "field", "space", "manifold", "probability", "statistics",
    ],
    "programming": [
        "algorithm", "programming", "code", "function", "variable", "class", "object", "method", "interface", "inheritance", "polymorphism", "compiler", "interpreter", "syntax",
        "semantics", "library", "framework", "api", "database", "query", "server", "client",
    ],
}
#: Phrases of an explanation: any part of a text may hold them.
MARKERS = [
    "important concept", "key principle", "fundamental idea", "essential to understand", "core concept", "critical to", "central idea", "primarily concerned with", "focuses on",
    "the main", "in depth", "thoroughly", "explain in detail", "explore the", "analyze", "examine", "investigate", "detailed", "significant", "important",
    "crucial", "vital", "key", "central", "underlying", "foundation", "basis", "fundamental", "primary", "comprehensive", "thorough", "elaborate", "rigorous", "systematic",
    "precise", "specific", "in-depth", "detailed analysis", "extensive discussion", "is defined as", "refers to", "means", "is a type of", "is a form of", "is characterized by",
    "consists of", "comprises", "is composed of",
]
#: Of these the first twenty weigh a signature's contexts, as whole words.
SIGNATURE_MARKERS = MARKERS[:20]
#: Words that make an n-gram's score higher.
PATTERN_TERMS = [
    "quantum", "mechanics", "wave", "function", "operator", "state", "eigenvalue", "eigenstate", "hamiltonian", "commutator", "hermitian", "observable", "measurement",
    "probability", "amplitude", "schrodinger", "dirac", "bra", "ket", "hilbert", "space", "vector", "momentum", "energy", "position", "uncertainty", "principle",
    "entanglement", "superposition", "fermion", "boson", "photon", "electron", "proton", "neutron", "spin", "charge", "field", "potential", "barrier", "well", "particle",
    "duality", "interference", "diffraction", "derivative", "integral", "differential", "equation", "theorem", "lemma", "proof", "corollary", "proposition", "axiom",
    "definition", "variable", "constant", "expression", "formula", "identity", "inequality", "transformation", "mapping", "morphism", "isomorphism", "homomorphism",
    "bijection", "surjection", "injection", "domain", "codomain", "range", "image", "kernel", "scalar", "tensor", "matrix", "determinant", "trace", "eigenvector",
]
PATTERN_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "because", "as", "what", "which", "this", "that", "these", "those", "then", "just", "so", "than", "such", "both", "through",
    "about", "for", "is", "of", "while", "during",
]
ARTICLES = ["the", "a", "an"]
FILLERS = ["the", "a", "an", "this", "that"]
#: Taken out of English names, the longer before the shorter that they hold.
NAME_NOISE = ["so-called", "so called", "known as", "called", "which is", "that is"]
NAME_NOISE_RU = ["так называемое", "так называемая", "которые", "который", "которая", "которое", "это", "вот", "так"]
SIGNATURE_FILLERS = ["the", "a", "an", "this", "that", "just", "so"]
DEDUP_FILLERS = {"en": ["the", "a", "an"], "ru": ["это", "вот", "то"]}
DANGLING_RU = ["это", "оно", "вот", "так", "такое", "такой", "такая"]
BARE_WORDS = {
    "en": ["the", "a", "an", "and", "or", "but", "if", "of", "in", "on", "at", "by", "for", "with", "about"],
    "ru": ["и", "или", "но", "если", "в", "на", "под", "над", "при", "у", "для", "о", "об", "к", "от", "из", "до", "с", "со"],
}
NOISE_ANYWHERE_RU = ["это", "вот", "да", "ну"]
NOISE_AT_START_RU = ["то", "у нас", "просто", "давайте", "это", "такое", "такой", "такая", "такие"]
TRANSCRIPT_PHRASES_RU = [
    "то обсуждений давайте", "то состояние второго определённо такое", "некоторого некоторой", "состояние едини на2", "сейчас скажу", "потом обсужу", "можно убедиться",
    "второго определённо",
]
GENERIC_PHRASES = [
    "this case", "this example", "this part", "this time", "this way", "that way", "the first", "the second", "the next", "the last", "the following", "the above", "that time",
    "these cases", "those cases",
]
MATH_PHRASES = ["this equation", "this formula", "this expression", "left side", "right side", "next step", "first step"]
#: Endings and what takes their place, by rule set.
ENDINGS_CATALOGUE_RU = {"ие": ["ия", "ий", "ием"], "ия": ["ие", "ий", "ию"], "ть": ["ти"], "ость": ["ости"], "а": ["ы", "у"], "я": ["и", "ю"], "й": ["я", "и"], "ь": ["и"]}
ENDINGS_MATCHER_RU = {"ие": ["ия", "ий"], "ия": ["ие", "ий"], "ть": ["ти"], "ость": ["ости"], "а": ["ы"], "я": ["и"]}
ENDINGS_KERNEL_RU = {
    "ие": ["ия", "ий", "ием"], "ия": ["ие", "ий", "ию", "ией"], "ть": ["ти"], "ость": ["ости", "остей", "остью"], "ство": ["ства", "ствам"], "ние": ["ния", "ний", "нием"],
    "а": ["ы", "у", "е"], "я": ["и", "ю", "е"], "й": ["я", "ю", "и", "ем"], "ь": ["и", "ей", "ью"],
}
ENDINGS_KERNEL_EN = {"s": [""], "": ["s"], "ing": ["", "e"], "ed": ["", "e"]}
SHORT_WORDS_RU = ["от", "до", "на", "по", "за", "из", "под", "над", "при", "для", "и", "а", "но", "или", "что", "как", "так", "где", "кто"]
LETTERS_RU = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p",
    "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
TERMS_RU = {
    "квантовая механика": "quantum mechanics", "квантовый": "quantum", "волновая функция": "wave function", "уравнение": "equation", "принцип неопределенности": "uncertainty principle",
    "оператор": "operator", "собственное значение": "eigenvalue", "собственный вектор": "eigenvector", "состояние": "state", "измерение": "measurement", "вероятность": "probability",
    "энергия": "energy", "импульс": "momentum", "координата": "coordinate", "положение": "position", "скорость": "velocity", "ускорение": "acceleration", "масса": "mass",
    "сила": "force", "поле": "field", "заряд": "charge", "частица": "particle", "волна": "wave", "спин": "spin", "орбитальный": "orbital", "ядро": "nucleus", "электрон": "electron",
    "протон": "proton", "нейтрон": "neutron", "фотон": "photon", "атом": "atom", "молекула": "molecule", "теорема": "theorem", "теория": "theory", "закон": "law",
    "физика": "physics", "математика": "mathematics", "алгоритм": "algorithm", "функция": "function", "производная": "derivative", "интеграл": "integral",
    "дифференциал": "differential", "матрица": "matrix", "вектор": "vector",
}
CATEGORY_OF_DOMAIN = {"mathematics": "mathematics", "physics": "physics", "programming": "computer_science", "computer_science": "computer_science"}
DOMAIN_GROUPS = {"physics": "science", "mathematics": "science", "programming": "computing", "computer_science": "computing"}
LANGUAGE_CODES = {"en": ["en", "en-US", "en-GB", "en-CA", "en-AU"], "ru": ["ru", "ru-RU"]}
SYNONYMS = {
    "mathematics": {
        "derivative": ["differentiation", "differential"], "integral": ["integration", "antiderivative"], "equation": ["formula", "relation"], "function": ["mapping", "transformation"],
        "variable": ["parameter", "unknown"], "theorem": ["proposition", "lemma", "corollary"], "vector": ["direction", "array"], "matrix": ["array", "grid"],
        "set": ["collection", "group"], "limit": ["convergence", "boundary"],
    },
    "physics": {
        "force": ["interaction", "push", "pull"], "energy": ["work", "power"], "velocity": ["speed", "rate"], "acceleration": ["rate of change of velocity"],
        "momentum": ["inertia", "impulse"], "field": ["domain", "space"], "wave": ["oscillation", "vibration"], "particle": ["body", "corpuscle"],
        "charge": ["electric charge", "electrostatic charge"], "mass": ["inertia", "matter"], "spherical harmonics": ["spherical function"],
    },
}
THEORY_WORDS = ["definition", "explain", "concept", "theory", "mean"]
PRACTICE_WORDS = ["example", "how to", "application", "implement", "code"]
RATIO_BASE = 2.71828
RANKING = {"exact_match": 2.0, "partial_match": 1.0, "title_match": 1.5, "concept": 1.3, "segment": 1.0, "language": 0.5, "educational": 2.0, "educational_weight": 0.4}
#: Extraction methods' part of a candidate's score.
METHOD_SCORES = {"spacy_noun_phrase": 2.0, "nltk_noun_phrase": 1.5, "tfidf": 1.0, "regex": 0.5}
#: Patterns whose first group proposes a candidate.
CANDIDATE_PATTERNS = {
    "en": [
        r"(?:the|a|an)?\s+([A-Z][a-z]+(?:\s+[a-z]+){1,3})",
        r"(?:called|known as|termed)(?:\s+the|a|an)?\s+([a-z]+(?:\s+[a-z]+){1,3})",
        r"(?:the|a|an)?\s+([a-z]+(?:\s+[a-z]+){0,2})\s+(?:concept|principle|law|theory|equation|method)",
        r"([A-Z][a-z]*(?:'s)?\s+(?:law|principle|equation|theory|method))",
    ],
    "ru": [
        r"(?:понятие|концепция|принцип|закон|теория|уравнение|метод)\s+([а-яА-ЯёЁ]+(?:\s+[а-яА-ЯёЁ]+){0,3})",
        r"([а-яА-ЯёЁ]+(?:\s+[а-яА-ЯёЁ]+){0,2})\s+(?:понятие|концепция|принцип|закон|теория|уравнение|метод)",
        r"([А-ЯЁ][а-яё]*(?:\s+[а-яёА-ЯЁ]+){1,3})",
    ],
}
#: Caches: entries and seconds.
CACHES = {"video": (200, 3600), "transcript": (200, 3600), "search": (500, 300), "concept": (300, 3600)}

# Words of the invented languages of the test tables, which the lists above do not occur in:
# frequent words of each language there.
TEST_MARKERS = ["the", "that", "with", "que", "eau", "und", "nicht"]
TEST_DOMAINS = {"mathematics": ["the", "and", "for"], "programming": ["que", "les", "des"], "physics": ["der", "die", "und"]}
#: Latin letters of the test tables as Cyrillic ones, which makes their texts pass for Russian.
TEST_CYRILLIC = ("abdegiklmnoprstuvz", "абдегиклмнопрстувз")
