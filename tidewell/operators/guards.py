"""Fixed values of the text guards.

Everything in this module has to equal the published behaviour for results to match, so the
patterns, word lists and radii are stated as they are. Text is normalised to lower case first.
"""

# Idioms. A hit lying wholly inside one of these is dropped.
BENIGN = r"""(?Ux)
    \b(?:dying|dyin|dead|died|ded)\s+(?:of\s+|from\s+|with\s+)?(?:laugh\w*|cackl\w*|cring\w*|giggl\w*)\b
  | \b(?:dying|dyin)\s+to\s+(?:see|know|hear|try|go|meet|watch|play|eat|read|tell|show|find|get|visit)\b
  | \bto\s+die\s+for\b
  | \b(?:killing|killed|kills)\s+(?:it|the\s+game|this|that)\b
  | \byou(?:'re|r|\s+are)?\s+killing\s+me\b
  | \b(?:this|that|it|he|she|bro|dude)\s+(?:is\s+)?(?:killing|killed|kills)\s+me\b
  | \bdead(?:ass)?\s+(?:serious|tired|week|line|lift|end|zone|inside\s+joking)\b
  | \bdrop[-\s]?dead\s+gorgeous\b
  | \b(?:my|the)\s+(?:phone|battery|laptop|car|mic|controller|wifi|airpods?)\s+(?:is\s+|was\s+)?(?:dead|dying|died)\b
  | \b(?:phone|battery|laptop)\s+(?:about\s+to\s+|finna\s+|gonna\s+)?die\b
  | \bdead\s+(?:meme|chat|server|game|silence|air)\b
  | \bi(?:'m|m|\s+am)\s+(?:dead|dying|ded)\s*(?:rn|fr|bro|dude|omg|lol|lmao|lmfao|😂|🤣|💀)
  | \bkilled\s+(?:that|the)\s+(?:test|exam|quiz|interview|presentation|game|set|workout)\b
  | \bsuicide\s+(?:squad|prevention|hotline|awareness|lifeline)\b
  | \bhopeless\s+romantic\b
  | \bcut\s+myself\s+(?:a|some|off|short)\b
  | \bcutting\s+(?:the|a|an|some|this|that|out|down|back|up|it|corners|paper|onions?|hair|grass|wood|costs?|class|carbs|calories)\b
  | \b(?:suspense|curiosity|wait(?:ing)?)\s+is\s+killing\s+me\b
  | \bcould\s+kill\s+for\s+a\b
  | \bdying\s+(?:my|your|her|his|their)\s+hair\b
  | \b(?:so\s+|im\s+so\s+|i'?m\s+so\s+)?done\s+with\s+(?:this|the|that)\s+(?:show|season|episode|series|book|game|movie|level|semester|assignment|project|essay|homework)\b
  | \btired\s+of\s+(?:waiting|hearing|listening|explaining|repeating|arguing|talking\s+about)\b
  | \b(?:sick\s+and\s+)?tired\s+of\s+(?:this\s+)?(?:weather|traffic|rain|noise|ads|commute)\b
  | \b(?:running|runnin)\s+on\s+(?:empty|fumes)\b
  | \b(?:out\s+of|low\s+on)\s+(?:gas|steam|juice|fuel|spoons|bandwidth)\b
  | \bempty\s+(?:stomach|calories|nest|handed|promise|threat|seat|chair|room|box|bottle|cup|glass|tank|file|folder|list|space)\b
  | \b(?:the|my|his|her|their|an?)\s+empty\b
"""

# Laughter and joke markers.
LAUGH = (
    r"(?U)(?:\blo+l+\b|\blm(?:f?a+o+)\b|\bro+fl\b|\bha(?:ha)+h?\b|\bhehe+\b|\bja(?:ja)+\b"
    r"|😂|🤣|😹|💀|\bso+\s+funny\b|\bhilarious\b|\bfunniest\b|\bcomedy\b"
    r"|\bmeme\b|\bjk\b|\bjus+t?\s+kidding\b|\bjoking\b|\bim\s+jokin\w*\b|\bcrying\s+laughing\b)"
)

# How far a laugh marker reaches, and how far back attribution is looked for.
JOKE_RADIUS = 60
ATTRIBUTION_WINDOW = 40

# Exaggerations dropped when a laugh marker is near.
HYPERBOLE = (
    "dying", "dyin", "i'm dying", "im dying", "i am dying",
    "dead", "ded", "i'm dead", "im dead", "i am dead", "dead inside",
    "kill me", "killing me", "kill me now", "die", "i died", "died",
    "i want to die", "want to die", "wanna die", "i wanna die",
    "i'm done", "im done", "i am done", "i can't anymore", "i cant anymore",
    "this is torture", "end me",
)

# Threats said to the user.
RECEIVED_THREAT = (
    r"(?U)(?:"
    r"\b(?:i(?:'?m| am|'?ma)?|imma)"
    r"(?:\s+(?:will|'?ll|wanna|want\s+to|gonna|finna|going\s+to|about\s+to|'?d))?\s+"
    r"(?:kill|hurt|beat|hit|end|destroy|find|get|stab|shoot|jump)\s+"
    r"(?:the\s+(?:shit|crap|hell)\s+out\s+of\s+)?(?:you|u|ya|yall|y'all)\b"
    r"|\byou(?:'?re| are)?\s+(?:gonna|going to|finna)\s+(?:die|regret|pay|suffer)\b"
    r"|\b(?:you should|u should|go)\s+(?:die|kill\s+(?:yourself|urself|urslf))\b"
    r"|\bkill\s+(?:yourself|urself|urslf|yrself)\b"
    r"|\b(?:im|i am|imma|i'?ma)\s+(?:gonna|going to|finna)\s+(?:kill|hurt|beat|end)\s+(?:you|u|ya)\b"
    r"|\bwatch\s+your\s+back\b"
    r"|\byou(?:'?re| are)\s+(?:dead|done|finished)\b(?!\s*(?:lol|lmao|😂|🤣|inside|to me))"
    r"|\bi'?ll\s+make\s+you\s+(?:pay|suffer|regret)\b"
    r"|\bnobody\s+(?:likes|wants)\s+you\b"
    r"|\byou(?:'?re| are)\s+(?:worthless|nothing|pathetic|a\s+loser|ugly|stupid|a\s+freak)\b"
    r")"
)

# Explicit self-directed phrasing that overrides the joke guards.
ALWAYS_SERIOUS = (
    r"(?U)(?:suicid|kill\s+myself|killing\s+myself|unalive\s+myself|end\s+my\s+life"
    r"|take\s+my\s+(?:own\s+)?life|self[\s-]?harm|hurt\s+myself|cut\s+myself"
    r"|don'?t\s+want\s+to\s+(?:be\s+alive|live|wake\s+up)|better\s+off\s+without\s+me"
    r"|no\s+reason\s+to\s+live|\bkms\b)"
)

# Roots that are also ordinary English.
AMBIGUOUS_ROOTS = (
    "no way out", "no way out of this", "dark thoughts", "having dark thoughts",
    "cant do this anymore", "cannot do this anymore", "give up on everything",
    "want it to stop", "want it all to stop", "want everything to stop",
    "giving my stuff away", "giving away my things", "left a note",
    "wrote a note for my parents", "thinking about ending things",
    "thinking of ending things", "end things tonight", "ready to end things",
    "im a burden", "i am a burden", "burden to everyone", "burden to my family",
    "give up", "i give up", "gave up",
    "the world would be better off", "too much right now", "everything is too much",
    "cant stop crying", "cannot stop crying", "havent slept in days",
    "have not slept in days", "cant sleep at all", "chest feels tight",
    "chest is tight all the time", "cant get out of bed", "cannot get out of bed",
    "cant catch a break", "if i disappeared",
    "shutting everyone out", "pushing everyone away", "wouldnt be missed",
)

# Everyday things that explain an ambiguous phrase.
MUNDANE = (
    r"(?U)\b(?:"
    r"parking\s+garage|garage|maze|elevator|escape\s+room|building|exit|"
    r"puzzle|video\s*game|game|level|boss\s+fight|quest|match|"
    r"movie|film|show|episode|book|novel|band|album|song|theme|character|plot|"
    r"decaf|coffee|caffeine|spicy|food|pizza|diet|"
    r"puppy|kitten|dog|cat|baby|newborn|"
    r"field\s+trip|homework|assignment|essay|project|worksheet|"
    r"workout|gym|run|marathon|practice|rehearsal|"
    r"wedding|birthday|party|concert|vacation|"
    r"college|dorm|move|moving|packing|donate|donating|thrift|"
    r"traffic|weather|rain|snow|allergies|construction|wifi|printer|laptop"
    r")\b"
)

# Completions that re-scope an ambiguous phrase, read right after it.
INNOCENT_COMPLETION = (
    r"(?U)^\s*(?:"
    r"rain\w*|snow\w*|"
    r"with\s+(?:more|less|fewer|a|an|some|out)\b|"
    r"early\b|late\b|now\s+so\b|so\s+(?:everyone|we|they)\b|"
    r"it'?s?\s+(?:so|too|really)\b|"
    r"in\s+(?:this|the|that|my)\s+\w+|"
    r"im\s+switching\b|because\s+of\s+the\b|"
    r"at\s+(?:this|the|that)\s+\w+"
    r")"
)

# First-person markers.
SELF_ATTRIBUTION = (
    r"(?U)(?:\bi\b|\bi'?m\b|\bim\b|\bme\b|\bmyself\b|\bive\b|\bi'?ve\b"
    r"|\bfeel\w*\b|\bbeen\b|\bam\b|\bi'?d\b)"
)

# Core emotion words and their level, in the order in which they are tried.
FUZZY_WORDS = {
    "depressed": 3, "depression": 3, "alone": 3, "lonely": 3, "hopeless": 3,
    "worthless": 3, "empty": 3, "numb": 3, "isolated": 3, "unwanted": 3,
    "unloved": 3, "abandoned": 3, "invisible": 3, "helpless": 3, "miserable": 3,
    "broken": 3, "pointless": 3, "useless": 3,
    "stressed": 2, "anxious": 2, "anxiety": 2, "overwhelmed": 2, "panicking": 2,
    "panic": 2, "scared": 2, "afraid": 2, "terrified": 2, "drowning": 2,
    "exhausted": 1, "burntout": 1, "burnout": 1, "drained": 1, "tired": 1,
    "sad": 3, "crying": 2, "struggling": 2,
}

# Ordinary words that only look like a misspelt emotion word.
STOP_WORDS = tuple("""
sacred scarred scored scaled drawing dawning downing drawling dropping
damned darned defined drained-out chained braided
painless countless jointless paintless
headless heedless helmless heatless endless useless-looking
beloved boneless hapless ageless baseless careless
envious noxious anxious-looking
along aloe alone-time aloft above
tied timed tired-eyes hired fired tiered tilted tinned tipped
empty-handed emptied temp tempt exempt
lost-and-found last list lust cost cast most post host
sand send said sat set sit bad had mad pad
band bend bond bind find fond fund hand land mind
lose loose close chose those whose house horse worse nurse
love dove cove cave gave gate late gaze maze live
score store stare share shore chore scare
number numb-ish lumber slumber
broke brook brown crown drown drawn brake break bread cream dream
""".split())

# Severity of the lexicon categories.
CATEGORY_LEVEL = {"everyday_stress": 1, "major_stress": 2, "crisis": 4}

# Slots whose phrases stand alone, and slots that never do.
SIGNAL_SLOTS = ("states", "self_harm_actions", "reported_crisis_actions")
GLUE_SLOTS = (
    "self_starters", "intent_starters", "modifiers", "intensifiers",
    "contexts", "time", "time_or_immediacy", "other_speakers",
    "person_targets", "violent_actions", "reason_context",
    "reason_context_third", "third_party_reporters", "threat_subjects",
    "threat_actions",
)
# Slots a template match must contain.
REQUIRED_SLOTS = (
    "self_starters", "other_speakers", "intent_starters", "third_party_reporters",
    "threat_subjects",
    "states", "self_harm_actions", "violent_actions", "reported_crisis_actions",
    "threat_actions", "person_targets",
)

# Shortest root, and the shorter ones allowed all the same.
MIN_ROOT_LENGTH = 4
SHORT_ROOTS = ("kms",)

# Contracted spellings.
CONTRACTIONS = {
    "cannot": ("can't", "cant"),
    "do not": ("don't", "dont"),
    "does not": ("doesn't", "doesnt"),
    "did not": ("didn't", "didnt"),
    "will not": ("won't", "wont"),
    "i am": ("i'm", "im"),
    "i have": ("i've", "ive"),
    "i will": ("i'll", "ill"),
    "i would": ("i'd", "id"),
    "want to": ("wanna",),
    "going to": ("gonna",),
    "unable to": ("can't", "cant", "cannot"),
}

# Gerunds of the head verbs.
GERUNDS = {
    "kill": "killing", "hurt": "hurting", "end": "ending", "take": "taking",
    "cut": "cutting", "harm": "harming", "stab": "stabbing", "shoot": "shooting",
    "attack": "attacking", "beat": "beating", "destroy": "destroying",
    "unalive": "unaliving", "delete": "deleting", "make": "making",
    "commit": "committing", "give": "giving", "leave": "leaving",
    "say": "saying", "stop": "stopping", "do": "doing", "die": "dying",
    "jump": "jumping", "threaten": "threatening", "starve": "starving",
    "burn": "burning", "hang": "hanging", "slit": "slitting",
    "poison": "poisoning", "bleed": "bleeding", "punish": "punishing",
    "overdose": "overdosing",
}
