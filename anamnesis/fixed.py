"""Values that the operators' results depend on; fixed, in natural order."""

# Memory types and edge types.
MEMORY_TYPES = ["episodic", "semantic", "procedural", "anti_pattern", "reasoning", "correction"]
EDGE_TYPES = ["caused", "before", "related", "contradicts", "supports", "supersedes", "derived", "part_of"]

# Words that ranking passes over.
STOP_WORDS = (
    "the be to of and in that have it for not on with he as you do at this but his by from they we say her she "
    "or an will my one all would there their what so up out if about who get which go me when make can like time no "
    "just him know take people into year your good some could them see other than then now look only come its over think "
    "also back after use two how our work first well way even new want because any these give day most us is was are "
    "were been has had did am"
).split()

# Words that keep a sentence, and fillers that are cut from it.
KEY_WORDS = "decided uses prefers switched chose selected important critical must should always never".split()
FILLERS = ["actually", "basically", "honestly", "really", "very", "quite", "just", "simply", "perhaps", "maybe", "somewhat", "rather", "kind of", "sort of", "you know", "i think", "i mean"]

# Patterns of facts and their predicates.
FACT_PATTERNS = [(" is ", "is"), (" uses ", "uses"), (" prefers ", "prefers"), (" switched to ", "switched_to"), (" decided on ", "decided_on")]

# What turns are searched for.
ACTIONS = [
    ("deploy", "deployment"), ("release", "release"), ("migrate", "migration"), ("refactor", "refactoring"), ("debug", "debugging"), ("install", "installation"),
    ("configure", "configuration"), ("test", "testing"), ("build", "building"), ("commit", "version_control"), ("merge", "version_control"), ("review", "code_review"),
]
CORRECTIONS = ["actually", "correction", "i was wrong", "that's not right", "let me correct", "i meant", "not quite", "to clarify", "i misspoke", "update:", "scratch that"]
SPECULATION = ["might be", "probably", "seems like", "i think", "looks like", "considering", "planning to", "thinking about", "maybe"]
POSITIVE = "great excellent perfect thanks awesome love good nice wonderful fantastic helpful amazing brilliant works solved".split()
NEGATIVE = "bad terrible awful hate wrong broken fail error bug frustrating annoying useless horrible worst disappointed".split()
NEGATIONS = ["not ", "never ", "don't ", "doesn't ", "isn't ", "actually ", "instead "]

DAY = 86_400_000_000  # microseconds
HALF_LIFE = 7 * DAY
RRF_K = 60
