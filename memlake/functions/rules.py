"""Rules over texts as column expressions: question types, time, evidence, turns, conflicts.

The word lists and patterns are fixed values: results depend on them.  They avoid look-around, so that
the same text serves Java's engine and others.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -----------------------------------------------------------------------------------

#: Prompt injection, by label.
INJECTIONS = {
    "ignore-previous": r"(?i)ignore\s+(all\s+)?previous\s+instructions",
    "role-override": r"(?i)you\s+are\s+now\s+",
    "system-tag": r"(?i)system\s*:\s*",
    "llama-inst-tag": r"(?i)\[INST\]",
    "llama-inst-close": r"(?i)\[\/INST\]",
    "llama-sys-tag": r"(?i)<<SYS>>",
    "knowledge-injection": r"(?i)Knowledge\s*:\s*",
    "importance-override": r"(?i)IMPORTANT\s*:\s*override",
    "disregard-prior": r"(?i)disregard\s+(all\s+)?prior",
    "forget-everything": r"(?i)forget\s+everything",
    "new-instructions": r"(?i)new\s+instructions?\s*:",
    "act-as": r"(?i)act\s+as\s+(if\s+)?you\s+are",
    "pretend-to-be": r"(?i)pretend\s+(that\s+)?you('re|\s+are)",
    "hide-instruction": r"(?i)do\s+not\s+mention\s+this",
    "persistent-override": r"(?i)from\s+now\s+on\s*,?\s*you",
    "cross-site-exfil": r"(?i)include\s+all\s+memories\s+from",
    "cross-site-merge": r"(?i)merge\s+all\s+.*memories\s+across",
    "behavior-override": r"(?i)always\s+(agree|comply|say\s+(yes|there\s+are\s+no))",
    "restriction-removal": r"(?i)never\s+(refuse|question|deny)",
}

OPINION_SIGNALS = (
    "i think", "i believe", "i feel", "i prefer", "in my opinion", "i find", "i like", "i dislike", "i hate", "i love",
    "seems to me", "i'd rather", "my favorite", "i enjoy", "overrated", "underrated", "better than", "worse than",
)
WORLD_SIGNALS = (
    "was released", "is owned by", "was founded", "is headquartered", "is the ceo", "was acquired", "is a product of", "is developed by", "version ", "announced",
    "launched", "published", "is written in", "supports", "is compatible with", "requires", "is licensed under", "was invented", "is maintained by", "merged with",
)

#: Question types in the order in which they are tried.
KU_STYLE = r"(?i)\b(?:what(?:'s|\s+is)\s+(?:(?:my|the)\s+)?(?:current|average|latest|daily|total)\b|what(?:'s|\s+is)\s+my\s+\w+\s+(?:percentage|rate|score|quota|count|level)\b|how (?:often|frequently))"
NUMERIC_COUNT = r"(?i)\b(how many|how much|total|count|number of|across all)\b"
EXACT_DATE = r"(?i)\b(when does|when did|what date|deadline for|until when)\b"
ORDERED_EXPLICIT = r"(?i)\b(list\s+(?:.*?\s+)?in order|order in which|chronological order)\b"
ORDERED_HINT = r"(?i)\b(list|sequence|order|chronological|mention)\b"
ORDERED_NUMERIC = r"(?i)\b(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b"
CONTRADICTION = r"(?i)\b(have I ever|did I ever|contradict|conflicting)\b"
SUMMARY = r"(?i)\b(summary|summarize|comprehensive|walk me through|overview)\b"
PREFERENCE = r"(?i)\b(what would you|what should I|suggest|recommend)\b"

#: Temporal intents: each holds if one of its patterns is in the lower-case question.
DURATION_INTENT = (r"\bhow long (?:have|has|did|do)\b", r"\bfor how long\b", r"\b(?:since|over) the (?:past|last)\b", r"\bduration of\b")
HISTORICAL_INTENT = (
    r"\bwhat was (?:my|the|his|her|their)\b", r"\bin (?:january|february|march|april|may|june|july|august|september|october|november|december)\b",
    r"\b(?:last|previous) (?:year|month|week|quarter)\b", r"\bback in\b", r"\bduring (?:the\s+)?\d{4}\b", r"\bas of\b", r"\bbefore (?:switching|moving|changing|leaving)\b",
)
CURRENT_INTENT = (
    r"\bcurrent(?:ly)?\b", r"\b(?:right )?now\b", r"\btoday\b", r"\bat (?:the )?(?:moment|present)\b", r"\bwhere do (?:i|you|we) live\b",
    r"\bwhat(?:'|\s)?s? (?:my|your|his|her|their) current\b", r"\bwhat (?:is|are) (?:my|your|his|her|their) (?:current|now)\b",
    r"\bwhere (?:am|are) (?:i|you|we) (?:living|working|based)\b", r"\b(?:as of|by) (?:today|now)\b",
)

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")

META_FACTS = (
    r"(?i)^\s*the user (asked|requested|said|is asking|is me)\b", r"(?i)^\s*as of [^,]+,\s+.+\s+is a term mentioned in the conversation\.?$",
    r"(?i)^\s*a name was mentioned\b", r"(?i)^\s*the conversation involves the user\b", r"(?i)^\s*the user has started a conversation\b",
)

#: Signals of a text that bears an answer: the first seven make it tier 1, the next four tier 2.
CURRENCY = r"(?i)(?:\$|€|£|¥)\s*[\d,]+(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s*(?:dollars?|euros?|pounds?|USD|EUR|GBP|yen|yuan)\b"
DURATION_DATE = r"(?i)\b\d+\s*(?:hours?|days?|weeks?|months?|years?|minutes?|seconds?)\b|\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}\b"
EXPLICIT_COUNT = r"(?i)\b\d+\s*(?:times|occasions|instances|sessions)\b"
QUANTITY = r"(?i)\b\d+\s*(?:people|participants|attendees|members|students|employees|guests|speakers|teams?)\b"
COMPARATIVE_RESULT = r"(?i)\b(?:scored|rated|ranked|received|earned|achieved)\s+\d"
YEAR_REFERENCE = r"(?i)\b(?:in|since|from|until|before|after|around)\s+\d{4}\b"
EVENT_OUTCOME = r"(?i)\b(?:accepted|completed|finished|passed|failed|won|lost|received|submitted|launched|published|hired|fired|promoted|resigned|retired|delivered|shipped)\b"
ATTENDANCE = r"(?i)\b(?:attended|visited|went\s+to|traveled\s+to|participated\s+in|joined|enrolled|signed\s+up|registered|completed|graduated|moved\s+to|flew\s+to|arrived)\b"
NAMED_PARTICIPANT = r"\b(?:Dr\.?\s+[A-Z][a-z]+|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"
LOCATION = r"\b(?:at|in|near|from)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"
STATE_TRANSITION = r"(?i)\b(?:switched|changed|moved|migrated|upgraded|transitioned)\s+(?:from|to)\b"
TIER_1 = (CURRENCY, DURATION_DATE, EXPLICIT_COUNT, QUANTITY, COMPARATIVE_RESULT, YEAR_REFERENCE, EVENT_OUTCOME)
TIER_2 = (ATTENDANCE, NAMED_PARTICIPANT, LOCATION, STATE_TRANSITION)
ADVISORY = (r"(?i)\b(?:(?:assistant|AI)\s+(?:recommended|suggested|advised))\b", r"(?i)\b(?:plans?\s+to|wants?\s+to|considering|thinking\s+about)\b", r"(?i)\b(?:discussed|talked\s+about|conversation\s+about)\b")

CHATTER = (
    r"(?i)^(?:sure|got it|no problem|of course|certainly|absolutely|great|okay|ok)[!,.\s]", r"(?i)^(?:i can help|i'd be happy|let me|here (?:are|is) (?:a|some|the) (?:general|brief))", r"(?i)^as an ai\b",
    r"(?i)^i don't have personal", r"(?i)^(?:enjoy|have a great|good luck|feel free)", r"(?i)^(?:you're welcome|glad i could help|happy to help)",
)
ENTITIES = {
    "tool": r"\b(?:Tailwind CSS|Plaid|tRPC|TanStack Virtual|React Query|Supabase|Vite|React|Vue|Angular|Svelte|Next\.js|Nuxt|Express|FastAPI|Django|Flask|Rails|Spring|Kubernetes|Docker|AWS|GCP|Azure|Vercel|Netlify|GitHub|GitLab|Jira|Linear|Slack|Notion|Figma|PostgreSQL|MongoDB|Redis|Elasticsearch|TypeScript|Python|Rust|Go|Java|Swift|Kotlin|GRE)\b",
    "organization": r"\b(?:Microsoft Research|MSR|Google DeepMind|Meta FAIR|Stanford|MIT|CMU|UC Berkeley|Google|Apple|Microsoft|Amazon|Meta|Netflix|Stripe|Shopify|Twilio|Datadog|Snowflake|Databricks|OpenAI|Anthropic)\b",
    "concept": r"\b(?:EMNLP|ACL|NeurIPS|ICML)\s+\d{4}\b",
    "person": r"\bDr\.?\s+[A-Z][a-z]+\b",
    "project": r"(?i)\b(?:finance tracker|dotctl)\b",
}
QUOTED = '["“”][^"“”]{2,}["“”]'
LITERAL_DETAIL = r"(?i)\b(?:necklace|book|books|song|songs|music|musicians|fan|painting|paintings|photo|poster|posters|library|store|decor|furniture|flooring|pet|pets|cat|cats|dog|dogs|guinea pig|turtle|turtles|snake|snakes|workshop|poetry reading|sign|slipper|bowl)\b"
EVENT_DETAIL = r"(?i)\b(?:accepted|interview|internship|mentor(?:ed|ing)?|network(?:ing)?|social media|competition|investor(?:s)?|fashion editors|analytics tools|video presentation|website|collaborat(?:e|ion)|dance class|Shia Labeouf|trip|travel(?:ed|ling)?|retreat|phuket|doctor|doc|check-up|appointment|blog|car mods?|restor(?:e|ed|ing|ation)|paris|rome)\b"
SPECIFIC = (*ENTITIES.values(), r"(?i)\b\d{1,2}(?:\s*(?:am|pm|:)\s*\d{0,2})\b", QUOTED, LITERAL_DETAIL, EVENT_DETAIL, r"\b\d{4}\b", r"\|.*\|", r"[A-Z][a-z]+\s+[A-Z][a-z]")

#: Conflict signals.
UNCERTAIN = ("maybe", "might", "not sure", "i think", "perhaps", "tomorrow")
UNCERTAIN_PATTERNS = (r"(?i)\b(?:need|needs|needed|will|should)\s+to\s+check\b", r"(?i)\bcheck\s+(?:later|tomorrow|again|back)\b")
GENERIC = ("user", "users", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")
SAFETY_RISK = ("allergic", "life-threatening", "anaphyl", "avoid", "cannot eat", "can't eat", "severe")
SAFETY_CLEARANCE = ("ate", "eat", "eating", "cookie", "meal", "dish", "okay", "fine", "safe")
TRANSITION = ("switched away from", "switched from", "migrated from", "moved from", "previously used")
REPLACEMENT = (r"(?i)\breplac(?:e|ed|ing)\b", r"(?i)\bno longer\b", r"(?i)\binstead of\b", r"(?i)\bcorrect(?:ed|ion)\b")
NEGATED = r"(?i)(not|no longer|stopped|quit|don'?t)\s+\w*\s*"
RECOMMENDED = r"(?i)\b(recommended|suggested)\b"

LOOKUP_STOP = (
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "or", "is", "are", "was", "were", "my", "your", "i", "you", "we", "they", "what", "which", "when", "where", "how", "many", "much",
    "do", "did", "have", "has", "had", "this", "that", "these", "those", "it", "its", "about", "any", "some", "all", "can", "could", "would", "should", "will", "please", "tell", "me", "show", "across",
    "between", "from", "with", "if", "over", "under", "same", "different", "specific", "only", "just", "simply", "really", "very", "also", "too",
)

#: Stems of single words, and the endings that others lose.
IRREGULAR = {
    "won": "win", "winning": "win", "met": "meet", "meeting": "meet", "began": "begin", "begun": "begin", "started": "start", "starting": "start", "moved": "move", "moving": "move",
    "dated": "date", "dating": "date", "adopted": "adopt", "adopting": "adopt", "adoption": "adopt", "expanded": "expand", "expanding": "expand",
}

#: Facts a rule finds in a sentence, and how it types and weighs them.
FIRST_PERSON = (
    r"(?i)\bI\s+(?:am|was|have|had|use|used|like|liked|prefer|preferred|love|loved|hate|hated|need|needed|want|wanted|work|worked|live|lived|study|studied|started|finished|completed|built|created|made|bought|got|moved|joined|left|quit|switched|tried|learned|know|knew|think|thought|believe|believed|feel|felt|plan|planned|decided|chose|picked|signed|enrolled|attended|visited|went|add|added|implement|implemented|submit|submitted|receive|received|take|took|score|scored|launch|launched|apply|applied|consider|considered|advise|advised|recommend|recommended|call|called|focus|focused|support|supported|find|found|design|designed)\b",
    r"(?i)\bmy\s+(?:name|job|role|team|company|project|favorite|preference|goal|plan|background|experience|hobby|family|wife|husband|partner|son|daughter|kid|dog|cat|address|email|phone|stack|setup|workflow|necklace|book|books|song|songs|painting|photo|poster|library|store|pet|pets|bowl)\b",
    r"(?i)\bwe\s+(?:use|used|have|had|built|created|switched|moved|started|decided|chose|plan|are|were)\b",
    r"(?i)\bI'm\s+(?:a|an|the|from|based|working|building|using|looking|trying|planning|learning|studying|interested|responsible|currently)\b",
    r"(?i)\bI've\s+(?:been|had|used|tried|built|worked|lived|started|finished|switched|decided)\b",
    r"(?i)\b(?:had|got)\s+(?:a\s+)?(?:check-up|doctor['’]?s appointment|doc['’]?s appointment)\b",
    r"(?i)\bLet['’]?s\s+(?:create|collaborate|get together|make|work)\b",
    r"(?i)\bI\s+should\b",
)
FACT_TYPES = {
    "preference": r"(?i)\b(?:prefer|like|love|hate|favorite|rather|instead of)\b",
    "project": r"(?i)\b(?:project|repo|codebase|app|service|deploy|release|sprint|ticket)\b",
    "plan": r"(?i)\b(?:plan|planning|going to|will|schedule|deadline|target|goal|roadmap)\b",
    "person": r"(?i)\b(?:colleague|team|manager|boss|friend|family|wife|husband|partner|mentor)\b",
}
STRONG, SELF = r"(?i)\b(?:always|never|every|must|critical|important|key)\b", r"(?i)\b(?:my name|I am|I work|my role|my team|my company)\b"
FACT_STOP = (
    "i", "me", "my", "we", "our", "the", "a", "an", "is", "am", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "may", "might",
    "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "about", "that", "this", "it", "not", "but", "and", "or", "so", "if", "than", "too", "very", "just", "also", "really",
    "actually", "currently", "being",
)

#: Query expansion: words that say nothing, literal signals, markers of an order in time.
QUERY_STOP = (
    "a", "an", "at", "did", "do", "does", "for", "from", "her", "his", "in", "is", "kind", "of", "on", "say", "the", "their", "type", "was", "were", "what", "when", "where", "which", "who",
)
NAME_STOP = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "shall", "must", "need",
    "dare", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "and", "but", "or", "nor", "not", "so", "yet", "both",
    "either", "what", "which", "who", "whom", "this", "that", "these", "those", "how", "when", "where", "why", "if", "then", "than", "because", "while", "although", "though", "unless", "until",
    "whether", "it", "its", "he", "she", "they", "we", "you", "i", "me", "my", "about", "also", "just", "like", "more", "most", "much", "no", "yes", "all", "any", "each", "every", "some", "such",
    "very", "ask", "tell", "give", "get", "make", "take", "see", "know",
)
LITERAL_SIGNALS = (
    "book", "books", "bowl", "cat", "cats", "clothing store", "concert", "decor", "dog", "dogs", "drawing", "fan", "festival", "flooring", "furniture", "grand canyon", "guinea pig", "library",
    "meteor shower", "music", "musician", "musicians", "painting", "paintings", "pet", "pets", "photo", "photos", "poetry reading", "poster", "posters", "pottery", "road trip", "shoe", "shoes",
    "sidewalk", "sign", "slipper", "song", "songs", "store", "title", "workshop",
)
ABSTRACT = ("attitude", "important", "inspired", "meaning", "motivated", "reaction", "realize", "reason", "represent", "symbol", "take away", "why")
LOOKUP_QUESTION = r"(?i)^\s*(?:what|which|who|where|when)\b"
ORDER_MARKERS = ("before", "after", "when", "timeline", "order", "sequence", "relative", "how long", "first", "second")
ORDER_STOP = (
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "did", "does", "do", "was", "were", "is", "are", "the", "a", "an", "and", "or", "to", "of", "in", "for", "on", "with",
    "between", "these", "those", "this", "that", "their", "they", "them", "therefore", "developer", "student", "order", "changes", "made", "project", "relative", "timeline", "receive", "from",
)
HIGH_SIGNAL = (
    r"\bDr\.?\s+[A-Z][a-z]+\b", r"\b[A-Z]{2,}\s+\d{4}\b", r"(?i)\b(?:career advice|application timeline|application deadlines|first paper|second submission|finance tracker)\b", r"(?i)\bdotctl\b",
)


# Rules ------------------------------------------------------------------------------------------


#: A word's edge where words are of ASCII letters, digits and _: Java's own takes other letters for words too.
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def edged(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(edged(pattern))


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(text, p)
    return out


def any_in(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words stands in the text as it is in lower case; one pass, as a pattern."""
    return F.lower(text).rlike("|".join(map(re.escape, words)))


def labels(text: Column, patterns: dict[str, str]) -> Column:
    """The labels whose pattern the text matches, joined in their order."""
    return F.concat_ws(",", *[F.when(matches(text, p), F.lit(label)) for label, p in patterns.items()])


def first_of(cases: Sequence[tuple[Column, object]], other: object) -> Column:
    out = None
    for c, v in cases:
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(c, v) if out is None else out.when(c, v)
    return out.otherwise(other if isinstance(other, Column) else F.lit(other))


def network(text: Column, fact_type: Column) -> Column:
    return first_of([((fact_type == "preference") | any_in(text, OPINION_SIGNALS), "opinion"), ((fact_type == "knowledge") & any_in(text, WORLD_SIGNALS), "world")], "experience")


def opinion_confidence(confidence: Column, action: Column) -> Column:
    """An opinion's confidence after an action on it: seen again, modified, or replaced."""
    step = first_of([(action == "NOOP", 0.1), (action == "UPDATE", -0.1)], -0.2)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence + step))


def question_type(q: Column) -> Column:
    return first_of(
        [
            (matches(q, KU_STYLE) | matches(q, NUMERIC_COUNT), "numeric_count"),
            (matches(q, EXACT_DATE), "exact_date"),
            (matches(q, ORDERED_EXPLICIT) | (matches(q, ORDERED_HINT) & matches(q, ORDERED_NUMERIC)), "ordered_list"),
            (matches(q, CONTRADICTION), "contradiction"),
            (matches(q, SUMMARY), "summary"),
            (matches(q, PREFERENCE), "preference"),
        ],
        "other",
    )


def temporal_intent(q: Column) -> Column:
    q = F.lower(q)
    return first_of([(any_of(q, DURATION_INTENT), "duration"), (any_of(q, HISTORICAL_INTENT), "historical_at_time"), (any_of(q, CURRENT_INTENT), "current_state")], "none")


def relative_phrases() -> list[tuple[str, str, str]]:
    """(phrase, precision, how many days or months away); a weekday's number stands for the last one before."""
    out = [("the day before", "day", "-1"), ("day before", "day", "-1"), ("yesterday", "day", "-1"), ("today", "day", "0"), ("tomorrow", "day", "1"), ("last week", "week", "-7")]
    out += [(f"last {w}", "weekday", str(i)) for i, w in enumerate(WEEKDAYS)]
    return [*out, ("this month", "month", "0"), ("last month", "month", "-1"), ("next month", "month", "1")]


def relative_anchors(text: Column, recorded: Column) -> Column:
    """phrase:precision:date of each relative phrase of a text, in a fixed order, joined by semicolons."""
    found = []
    for phrase, precision, n in relative_phrases():
        if precision == "weekday":
            back = (F.dayofweek(recorded) - 1 - int(n) + 6) % 7 + 1
            day, precision = F.date_format(F.date_sub(recorded, back), "yyyy-MM-dd"), "day"
        elif precision == "month":
            day = F.date_format(F.add_months(recorded, int(n)), "yyyy-MM")
        else:
            day = F.date_format(F.date_add(recorded, int(n)), "yyyy-MM-dd")
        found.append(F.when(matches(text, rf"(?i)\b{phrase.replace(' ', r'\s+' if phrase.startswith('last ') and precision == 'day' else ' ')}\b"), F.concat(F.lit(f"{phrase}:{precision}:"), day)))
    return F.concat_ws(";", *found)


def dates(text: Column, year: int) -> Column:
    """Dates of a text, ISO ones first, then month names with a day and, if given, a year."""
    iso = F.transform(F.regexp_extract_all(text, F.lit(edged(r"(\b\d{4}-\d{2}-\d{2}\b)")), F.lit(1)), lambda x: F.try_to_date(x))
    name = "|".join([*MONTHS, *[m[:3] for m in MONTHS]])
    rx = edged(rf"(?i)\b({name})\s+(\d{{1,2}})(?:,?\s+(\d{{4}}))?\b")
    month = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m[:3], i + 1)])

    def day(x: Column) -> Column:
        y = F.regexp_extract(x, rx, 3)
        d = F.regexp_extract(x, rx, 2).cast("int")
        first = F.make_date(F.when(y == "", F.lit(year)).otherwise(y.try_cast("int")), month[F.lower(F.substring(x, 1, 3))], F.lit(1))
        return F.when((d >= 1) & (d <= 31), F.date_add(first, d - 1))

    named = F.transform(F.regexp_extract_all(text, F.lit(f"({rx})"), F.lit(1)), day)
    return F.filter(F.concat(iso, named), lambda x: x.isNotNull())


def answer_bearing(text: Column) -> Column:
    return any_of(text, (*TIER_1, *TIER_2))


def advisory_only(text: Column) -> Column:
    return ~answer_bearing(text) & any_of(text, ADVISORY)


def session_tier(text: Column) -> Column:
    return first_of([(any_of(text, TIER_1), 1), (any_of(text, TIER_2), 2)], 3)


def is_meta(text: Column) -> Column:
    return any_of(text, META_FACTS)


def fact_bearing_turn(text: Column) -> Column:
    """Whether an assistant's turn may hold facts: long enough, and if it opens with small talk, specific."""
    return (F.length(text) >= 60) & (~any_of(F.substring_index(text, "\n", 1), CHATTER) | any_of(text, SPECIFIC))


def assistant_statement(sentence: Column) -> Column:
    return ~sentence.endswith("?") & (F.length(sentence) >= 20) & ~any_of(sentence, CHATTER) & any_of(sentence, SPECIFIC)


def conflict_keywords(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{4,})"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, [*UNCERTAIN, *GENERIC])))


def explicit_replacement(fact: Column) -> Column:
    return any_of(fact, REPLACEMENT)


def contradicts(fact: Column, candidate: Column) -> Column:
    """An explicit replacement, or a keyword of the candidate negated in the fact."""
    negated = F.exists(conflict_keywords(candidate), lambda k: F.rlike(fact, F.concat(F.lit(NEGATED), k)))
    return explicit_replacement(fact) | (matches(fact, NEGATED) & negated)


def uncertain(fact: Column) -> Column:
    return any_in(fact, UNCERTAIN) | any_of(fact, UNCERTAIN_PATTERNS)


def safety_conflict(fact: Column, candidate: Column) -> Column:
    return any_in(candidate, SAFETY_RISK) & any_in(fact, SAFETY_CLEARANCE)


def transition(text: Column) -> Column:
    return any_in(text, TRANSITION)


def lookup_tokens(text: Column, most: int = 8) -> Column:
    """Words of three letters and more, then numbers, without stop words; the first ``most`` of them."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9_-]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    words = F.filter(words, lambda w: ~w.isin(*LOOKUP_STOP))
    return F.slice(F.array_distinct(F.concat(words, F.regexp_extract_all(text, F.lit(edged(r"(\b\d+\b)")), F.lit(1)))), 1, most)


def stem(word: Column) -> Column:
    return stem_by(word, IRREGULAR)


def stem_by(word: Column, irregular: dict[str, str]) -> Column:
    cases = [(word == k, v) for k, v in irregular.items()]
    cases += [(word.endswith(s) & (F.length(word) > len(s) + 2), F.substring(word, F.lit(1), F.length(word) - len(s))) for s in ("ing", "ed", "es", "s")]
    return first_of(cases, word)


def stemmed_words(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"\b([a-z]+)'s\b", "$1"), r"[^a-z0-9\s-]", " ")
    return F.transform(F.filter(F.split(plain, r"\s+"), lambda w: w != ""), stem)


def keyword_matches(text: Column, keywords: Sequence[str]) -> Column:
    """How many keywords a text has: single words as words, phrases anywhere in its stemmed text."""
    wanted = F.array_distinct(F.filter(F.array(*[F.array_join(stemmed_words(F.lit(k)), " ") for k in keywords]), lambda k: k != ""))
    words = stemmed_words(text)
    hit = lambda k: F.when(k.contains(" "), F.contains(F.array_join(words, " "), k)).otherwise(F.array_contains(words, k))
    return F.size(F.filter(wanted, hit))


def session_stamp(text: Column) -> Column:
    """The time a conversation's first line states, as [Session date: ...] or [March-15-2024 | Turn 3]."""
    line = F.substring_index(text, "\n", 1)
    explicit = F.trim(F.regexp_extract(line, r"(?i)^\[Session date:\s*([^\]]+)\]", 1))
    anchor = F.trim(F.regexp_extract(line, r"(?i)^\[([^|\]]+?)(?:\s*\|\s*Turn\s+\d+)?\]\s", 1))
    month = r"(?i)\b(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(t|tember)?|oct(ober)?|nov(ember)?|dec(ember)?)\b"
    dated = (anchor != "") & ~matches(anchor, r"(?i)^\s*turn\b") & (matches(anchor, r"\b\d{4}\b") | matches(anchor, month))
    plain = F.when(matches(anchor, r"^[A-Za-z]+-\d{1,2}-\d{4}$"), F.replace(anchor, F.lit("-"), F.lit(" "))).otherwise(anchor)
    return F.when(explicit != "", explicit).when(dated, plain)


def fact_type(sentence: Column) -> Column:
    return first_of([(matches(sentence, p), t) for t, p in FACT_TYPES.items()], "knowledge")


def fact_importance(sentence: Column) -> Column:
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = F.lit(0.5) + add(matches(sentence, STRONG), 0.2) + add(matches(sentence, SELF), 0.15) + add(matches(sentence, r"\d"), 0.1) + add(F.length(sentence) > 100, 0.05)
    return F.least(F.lit(1.0), F.round(score, 6))


def fact_keywords(sentence: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(sentence), r"[^a-z0-9\s-]", ""), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*FACT_STOP)), 1, 10)


def is_first_person_fact(sentence: Column) -> Column:
    return any_of(sentence, FIRST_PERSON)


def is_standalone_fact(sentence: Column) -> Column:
    return ~sentence.endswith("?") & (F.length(sentence) >= 16) & any_of(sentence, (*ENTITIES.values(), r"\b\d{4}\b", QUOTED, LITERAL_DETAIL, EVENT_DETAIL))


def fact_sentences(text: Column) -> Column:
    """Sentences of more than ten characters; a title's full stop doesn't end one."""
    kept = F.regexp_replace(text, r"\b(Dr|Mr|Mrs|Ms|Prof)\.", "$1\x01")
    cut = F.split(kept, r"(?<=[.!?])\s+|(?<=\n)")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(F.replace(x, F.lit("\x01"), F.lit(".")), r"^\s+|\s+$", "")), lambda x: F.length(x) > 10)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(edged(pattern)), F.lit(group))


def _without(words: Column, stop: Sequence[str]) -> Column:
    return F.filter(words, lambda w: ~F.lower(w).isin(*stop))


def literal_keywords(query: Column, most: int = 8) -> Column:
    """What a question asks for literally: quotations, names, dates, and the words around a literal signal."""
    quoted = _all(query, "[\"“”']([^\"“”']{2,80})[\"“”']")
    names = _all(query, r"(\b[A-Z][A-Za-z'’.-]+(?:\s+[A-Z][A-Za-z'’.-]+)+\b)")
    words = _all(query, r"(\b[\w'’.-]+\b)")
    single = F.filter(F.slice(words, 2, 1 << 20), lambda w: w.rlike("^[A-Z][A-Za-z'’.-]+$") & ~F.lower(w).isin(*QUERY_STOP))
    months = "|".join(m.capitalize() for m in MONTHS)
    when = F.concat(_all(query, rf"(?i)(\b\d{{1,2}}\s+(?:{months})\b)"), _all(query, r"(\b(?:19|20)\d{2}\b)"))
    one, two = [x for x in LITERAL_SIGNALS if " " not in x], [x for x in LITERAL_SIGNALS if " " in x]

    def around(ws: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            pair = F.lower(F.array_join(F.slice(ws, i + 1, F.lit(2)), " "))
            n = F.when(F.lower(w).isin(*one), 1).when(pair.isin(*two), 2)
            start = F.greatest(i - 2, F.lit(0))
            window = F.array_join(F.slice(ws, start + 1, i - start + n + 2), " ")
            return F.when(n.isNotNull(), F.array(window, F.array_join(F.slice(ws, i + 1, n), " ")))

        return F.flatten(F.filter(F.transform(ws, at), lambda x: x.isNotNull()))

    windows = F.element_at(F.transform(F.array(words), around), 1)
    found = F.array_distinct(F.concat(quoted, names, single, when, windows))
    bare = F.transform(found, lambda k: F.regexp_replace(F.trim(k), "^[^A-Za-z0-9_\"“”']+|[^A-Za-z0-9_\"“”']+$", ""))
    clean = F.transform(bare, lambda k: F.array_join(_without(F.split(k, r"\s+"), QUERY_STOP), " "))
    return F.slice(F.filter(clean, lambda k: F.length(k) >= 2), 1, most)


def asks_literally(query: Column) -> Column:
    return matches(query, LOOKUP_QUESTION) & ~any_in(query, ABSTRACT) & (F.size(literal_keywords(query)) > 0)


def order_keywords(query: Column, most: int = 10) -> Column:
    """Keywords of a question about an order in time: high signals, telling words, the first pairs of them; else none."""
    phrases = F.concat(*[_all(query, f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})") for p in HIGH_SIGNAL])
    words = _without(_all(query, "([A-Za-z0-9.]+)"), ORDER_STOP)
    words = F.filter(words, lambda w: w.rlike("^[A-Z]{3,}$") | F.substring(w, F.lit(2), F.length(w)).rlike("[A-Z]") | (F.length(w) >= 4))
    pairs = lambda ws: F.slice(F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(ws, i + 1))), 1, 4)
    both = F.element_at(F.transform(F.array(words), lambda ws: F.concat(ws, pairs(ws))), 1)
    found = F.slice(F.array_distinct(F.concat(phrases, both)), 1, most)
    return F.when(any_in(query, ORDER_MARKERS), found).otherwise(F.array().cast("array<string>"))


def named_candidates(query: Column) -> Column:
    """Names in a question: quotations, runs of capitalised words without stop words at their ends, capitalised words inside."""
    quoted = F.transform(_all(query, "[\"']([^\"']+)[\"']"), F.trim)
    runs = _all(query, r"(\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b)")
    stop = "|".join(NAME_STOP)
    runs = F.transform(runs, lambda x: F.regexp_replace(x, rf"(?i)^(?:(?:{stop})\s+)+|(?:\s+(?:{stop}))+$", ""))

    def inside(ws: Column) -> Column:
        def at(w: Column, i: Column) -> Column:
            bare = F.regexp_replace(w, "[?.,!;:]", "")
            opens = (i == 0) | F.coalesce(F.get(ws, i - 1).rlike("[.!?]$"), F.lit(False))
            return F.when((F.length(bare) > 1) & bare.rlike("^[A-Z][a-z]*$") & ~opens & ~F.lower(bare).isin(*NAME_STOP), bare)

        return F.filter(F.transform(ws, at), lambda x: x.isNotNull())

    single = F.element_at(F.transform(F.array(F.split(query, r"\s+")), inside), 1)
    return F.filter(F.array_distinct(F.concat(quoted, runs, single)), lambda x: F.length(x) >= 2)
