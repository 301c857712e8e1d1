"""Facts out of facts: splitting, inferred entities and relations, event anchors, quoted titles.

Each of these gives several rows for one, by rules on the wording, so each is a table function that
stands behind a lateral join (see ``operators.facts``).  What must hold for right results are the word
lists and patterns below; the rules are small functions from one fact to a list of facts.

Defined results: a null or empty fact gives no rows; null keywords are derived from the fact, an empty
list is none; texts of any length are
matched whole; ties keep the order of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import regex

from memlake.functions.rules import edged

A, AI = re.ASCII, re.ASCII | re.IGNORECASE

# Fixed values ------------------------------------------------------------------------------------

ATTRIBUTIONS = (", as recommended by ", ", recommended by ", ", as suggested by ", ", suggested by ")
CHOICES = ("is using", "uses", "plans to use", "will use", "is considering", "chose", "selected")
ROLES = ("colleague", "friend", "advisor", "professor", "team lead")
TAKEN_UP = r"uses?|using|used|built|build|created|create|adopted|adopt|started using|start using|moved to|move to"
PETS = ("guinea pig", "dog", "cat")
BACKENDS = ("memory engine", "memory backend")

SELF_MARKERS = ("user ", "user's", "i ", "i'm", "i’ve", "i have", "my ")
USES = ("using", "use", "added", "implemented", "integration", "switched from", "switch from", "switch to")
WORKS_ON = ("building", "working on", "started", "created", "built", "update on")
PREFERS = ("prefer", "favorite", "love", "like", "can't go back")
KNOWS = ("advisor", "career advice from", "supportive", "recommendation letter", "recommended by")
STUDIES = ("focus on", "studying", "research", "paper on")
TOOLS = ("React", "TypeScript", "Vite", "Tailwind CSS", "Supabase", "Plaid", "tRPC", "React Query", "TanStack Virtual", "Vercel", "GRE", "EMNLP 2025", "ACL 2026")
ORGANISATIONS = ("OpenAI", "Anthropic", "Google", "Meta", "Microsoft Research", "Stanford", "MIT", "CMU", "UC Berkeley")
FULL_NAMES = {"msr": "Microsoft Research"}
PROJECT = r"tracker|project|app|repo|dashboard|paper"
CONCEPT = r"llms?|machine translation|transfer learning|low-resource|phd|languages?"
STUDY = r"focus on|research|paper on|studying"
NAMED_PROJECTS = ("dotctl",)
TITLE_CUES = r"recommended|reading|book(?:\s+\w+){0,2}\s+was|favorite childhood book was|favorite book was|song|songs|listening to|fan of"
#: (entity type, pattern, flags); the name is the group ``name``.
MENTIONS = (
    ("person", r"\b(?P<name>Dr\.\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", A),
    ("project", rf"\b(?P<name>(?:the\s+)?[A-Za-z0-9.-]+(?:\s+[A-Za-z0-9.-]+){{0,2}}\s+(?:{PROJECT}))\b", AI),
    ("organization", rf"\b(?P<name>{'|'.join(ORGANISATIONS)})\b", A),
    ("concept", rf"\b(?:{TITLE_CUES})\s+(?P<q>\"?)(?P<name>[A-Z][A-Za-z'’.-]+(?:\s+[A-Z][A-Za-z'’.-]+)*)(?P=q)", A),
    ("concept", r"[\"“”](?P<name>[^\"“”]{2,80})[\"“”]", A),
    ("concept", r"\b(?P<name>[A-Z][a-z]+)\s+(?:hid|hides|found|finds|was|is)\s+(?:his|her|a|an|the)\b", A),
)

#: (label, groups of words): a label holds if each group has a word in the text.
EVENTS = (
    ("internship.accepted", (("accepted",), ("internship",))),
    ("internship.interviewed", (("interview",), ("internship",))),
    ("mentorship.received", (("got mentored", "mentored by", "received mentorship"),)),
    ("mentorship.given", (("mentoring", "mentor aspiring", "one-on-one mentoring"),)),
    ("networking.first_visit", (("networking",), ("chose to attend", "go to networking", "visit networking", "yesterday"))),
    ("networking.followup", (("networking",), ("last networking event", "met investors"))),
    ("trip.paris", (("paris",),)),
    ("trip.returned_from_paris", (("paris",), ("return", "returned from", "returns from"))),
    ("trip.rome", (("rome",),)),
    ("trip.took_short_trip_rome", (("rome",), ("short trip",))),
    ("collaboration.decided", (("collaborat", "content creation", "social media management"), ("plan", "help", "offered"))),
    ("quote.mentioned", (("shia labeouf",),)),
    ("dance_class.attended", (("dance class",), ("group of friends",))),
)
#: A label that rules out another.
EXCLUDES = {"networking.followup": "networking.first_visit"}
NO_SUBJECT = ("Hey", "Long", "Yesterday", "Thats", "Awesome", "Oh", "Paris", "Rome", "Barcelona")
PERFORMED = r"played|playing|performed|performing|concert|show|stage|song|songs|dancing|singing"
NAME = r"[A-Z][A-Za-z'’.-]+"

KEYWORD_STOP = (
    "user", "users", "assistant", "the", "a", "an", "this", "that", "it", "they", "is", "are", "was", "were", "be", "been", "being", "am", "has", "have", "had", "does", "did", "do", "will", "would",
    "can", "could", "should", "may", "might", "and", "or", "but", "for", "with", "from", "into", "about", "over", "under", "of", "in", "on", "at", "to", "as", "by", "not", "no", "than", "then", "also",
    "instead", "earlier", "now", "still", "always", "never", "their", "there", "which", "when", "where", "while", "because", "these", "those", "some", "any", "all", "both", "each", "more", "most",
    "other", "such", "only", "very", "lives", "live", "vive", "usuario", "el", "la", "los", "las", "en", "de",
)
#: Dates, runs of capitalised words, technical tokens; edges of words are of ASCII letters, digits and _.
TELLING = (
    r"\b(?:\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s*\d{4}?|\b(?:19|20)\d{2})\b",
    r"\b\p{Lu}[\p{L}\p{M}'’-]*(?:\s+\p{Lu}[\p{L}\p{M}'’-]*)*",
    r"\b(?=[\p{L}\p{N}_-]*\p{Lu})(?=[\p{L}\p{N}_-]*[\p{Ll}\p{N}])[\p{L}\p{N}_-]+\b|\b\p{Ll}+\d[\p{L}\p{N}_-]*",
)
MOST_KEYWORDS, ENOUGH_KEYWORDS = 8, 2

# Keywords ----------------------------------------------------------------------------------------

_TELLING = [regex.compile(edged(p)) for p in TELLING]
_BREAK = regex.compile(r"[^\p{L}\p{N}'’-]+")


def keywords(text: str | None) -> list[str]:
    """Search terms of a fact: what its dates, names and technical tokens are; its content words if those are too few."""
    out: list[str] = []

    def add(raw: str) -> bool:
        """Take a term unless it is a stop word or within one taken before; whether there is room for more."""
        term = re.sub(r"(?i)['’]s$", "", re.sub(r"[.,;:]+$", "", raw.strip()))
        low = term.lower()
        if len(term) >= 2 and low not in KEYWORD_STOP and not any(low in x.lower() for x in out):
            out.append(term)
        return len(out) < MOST_KEYWORDS

    def run(words: list[str]) -> str:
        skip = next((k for k, w in enumerate(words) if w.lower() not in KEYWORD_STOP), len(words) - 1)
        return " ".join(words[skip:])

    told = (run(m[0].split()) for p in _TELLING for m in p.finditer(text or ""))
    if all(map(add, told)) and len(out) < ENOUGH_KEYWORDS:
        all(add(w) for w in _BREAK.split(text or "") if len(w) >= (4 if w.isascii() else 2))
    return out


# Splitting ---------------------------------------------------------------------------------------


class Fact(NamedTuple):
    fact: str
    type: str
    importance: float
    keywords: tuple[str, ...]


AS_OF = r"(?P<when>As of [^,]+,\s+)?"
_CHANGES = (
    (re.compile(AS_OF + r"(?P<who>user|we)\s+switched away from (?P<old>.+?) and (?P<new>.+?)[. ]*", AI), "switched away from {}"),
    (re.compile(AS_OF + r"(?P<who>user|we|project)\s+(?:switched|migrated|moved|changed)\s+from (?P<old>.+?) to (?P<new>.+?)[. ]*", AI), "previously used {}"),
)
_TAKEN_UP = re.compile(rf"(?:{TAKEN_UP})\s+(?P<what>.+)", AI)
_CHOICE = re.compile(rf"user (?:{'|'.join(CHOICES)}) (?P<what>.+)", AI)
_ROLE = re.compile(rf"(?:(?:their|the)\s+)?(?:(?:{'|'.join(ROLES)})\s+)?", AI)
_PET = re.compile(AS_OF + rf"(?P<name>{NAME}),\s+(?:my|user's)\s+(?P<pet>{'|'.join(PETS)})\.?", AI)


def bare(text: str) -> str:
    """Without white space around and full stops at the end."""
    return text.strip().rstrip(". ")


def sentence(when: str, text: str) -> str:
    text = text.strip()
    return bare(when + text if when else text[:1].upper() + text[1:]) + "."


def clamp(x: float) -> float:
    return max(0.0, min(1.0, x))


def joined(*keywords: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(k.strip() for k in keywords if k.strip()))


def standing(keywords: tuple[str, ...], text: str) -> tuple[str, ...]:
    """The keywords that stand in the text."""
    return tuple(k for k in keywords if k.strip().lower() in text.lower())


def attribution(f: Fact) -> list[Fact]:
    """Who recommended a thing, apart from the thing's use."""
    marker = next((m for m in ATTRIBUTIONS if m in f.fact), None)
    if not marker or f.fact.count(marker) != 1:
        return []
    main, said = f.fact.split(marker)
    main, person = bare(main) + ".", bare(said)
    person = person[_ROLE.match(person).end() :].strip()
    at = main.lower().find("user ") if main.startswith("As of ") else 0
    what = _CHOICE.fullmatch(main[max(at, 0) :])
    if not person or not what:
        return []
    told = f"{main[: max(at, 0)]}{person} recommended {bare(what['what'])}."
    return [f._replace(fact=main), Fact(told, "person", clamp(min(f.importance, 0.5)), joined(*f.keywords, person))]


def change(f: Fact) -> list[Fact]:
    """What holds after a change, and that it wasn't so before."""
    for pattern, past in _CHANGES:
        if not (m := pattern.fullmatch(f.fact)):
            continue
        when, who, new = m["when"] or "", m["who"].lower(), bare(m["new"])
        if taken := _TAKEN_UP.fullmatch(new):
            new = bare(taken["what"])
        if not new:
            continue
        now, before = sentence(when, f"{who} {'use' if who == 'we' else 'uses'} {new}"), sentence(when, f"{who} {past.format(bare(m['old']))}")
        out = [f._replace(fact=now, importance=clamp(f.importance), keywords=standing(f.keywords, now))]
        if any(b in new.lower() for b in BACKENDS):
            also = sentence(when, f"{who}'s current memory backend is {new}")
            out.append(f._replace(fact=also, importance=clamp(min(f.importance, 0.7)), keywords=joined(*standing(f.keywords, also), "memory backend", "backend")))
        return [*out, f._replace(fact=before, importance=0.45, keywords=standing(f.keywords, before))]
    return []


def reason(f: Fact) -> list[Fact]:
    """The reason given for a fact as a fact of its own."""
    at = f.fact.lower().find(" because ")
    main, why = bare(f.fact[: max(at, 0)]), bare(f.fact[at + len(" because ") :])
    if at < 0 or not main or not why:
        return []
    told = f"User reports that {why[0].upper()}{why[1:]}."
    return [f._replace(fact=main + "."), f._replace(fact=told, type="knowledge", importance=clamp(max(0.2, min(0.4, f.importance - 0.4))))]


def pet(f: Fact) -> list[Fact]:
    """A pet's name as a statement about its owner."""
    m = _PET.fullmatch(f.fact)
    if not m:
        return []
    kind = m["pet"].lower()
    return [f._replace(fact=f"{m['when'] or ''}user has a {kind} named {m['name']}.", type="person", keywords=joined(*f.keywords, m["name"], kind))]


def normalised(f: Fact) -> list[Fact]:
    """A fact split as far as the rules go; of equal facts of a type the last stands, at the first one's place."""
    facts = attribution(f) or change(f) or [f]
    for rule in (reason, pet):
        facts = [x for y in facts for x in (rule(y) or [y])]
    return list({(x.type, x.fact): x for x in facts}.values())


# Entities, relations -----------------------------------------------------------------------------

_MENTIONS = [(kind, re.compile(p, flags)) for kind, p, flags in MENTIONS]
_PROJECT, _CONCEPT, _STUDY = (re.compile(rf"\b(?:{p})\b", A) for p in (PROJECT, CONCEPT, STUDY))
_WORKS_AT, _AT = re.compile(r"\bwork(?:ing)?(?:\s+as\s+.+?)?\s+at\b", A), re.compile(r"\bat\b", A)
SELF = ("User", "person")


def shown(name: str) -> str:
    return re.sub(r"^[Tt]he\s+", "", name.strip()).rstrip(". ")


def of_keyword(keyword: str, text: str) -> tuple[str, str] | None:
    name = shown(keyword)
    name = FULL_NAMES.get(name.lower(), name)
    low, fact = name.lower(), text.lower()
    kinds = (
        ("tool", name in TOOLS),
        ("organization", name in ORGANISATIONS),
        ("person", re.match(r"Dr\.\s+[A-Z]", name)),
        ("project", _PROJECT.search(low) or f"the {low}" in fact or low in NAMED_PROJECTS),
        ("concept", _CONCEPT.search(low) or _STUDY.search(fact)),
    )
    return next(((name, kind) for kind, holds in kinds if holds), None)


def entities(f: Fact) -> list[tuple[str, str]]:
    """(name, type) of what a fact is about; the user first where the fact speaks of one."""
    found = [e for k in f.keywords if (e := of_keyword(k, f.fact))]
    for kind, pattern in _MENTIONS:
        for m in pattern.finditer(f.fact):
            name = m["name"].strip()
            found.append((name if kind == "person" else shown(name), kind))
    if any(m in f.fact.lower() for m in SELF_MARKERS):
        found = [SELF, *found]
    return list({(kind, name.lower()): (name, kind) for name, kind in found if name}.values())


def relations(f: Fact) -> list[tuple[str, str, str]]:
    """(source, type, target) between the entities of a fact, by its wording."""
    low, known = f.fact.lower(), entities(f)
    of = lambda kind: [n for n, k in known if k == kind and (n, k) != SELF]
    says = lambda words: any(w in low for w in words)
    out = []
    if SELF in known:
        for kind, words, to in (("uses", USES, "tool"), ("works_on", WORKS_ON, "project"), ("prefers", PREFERS, "tool"), ("knows", KNOWS, "person"), ("studies", STUDIES, "concept")):
            if says(words):
                out += [(SELF[0], kind, t) for t in of(to)]
        if _WORKS_AT.search(low):
            out += [(SELF[0], "works_at", t) for t in of("organization")]
    if _AT.search(low):
        out += [(p, "works_at", o) for p in of("person") for o in of("organization")]
    if says(USES):
        out += [(p, "uses", t) for p in of("project") for t in of("tool")]
    return list({(s.lower(), k, t.lower()): (s, k, t) for s, k, t in out if s != t}.values())


# Event anchors -----------------------------------------------------------------------------------

RECORDED = r"(?i)^As of ([A-Za-z]+ \d{1,2} \d{4}),\s*"
OCCURRED = r"(?i)\boccurred on ([A-Za-z]+ \d{1,2} \d{4})\b"
_ANCHORED = re.compile(r"\bevent anchor\s+[a-z.]+", AI)


def subject(f: Fact) -> str | None:
    """Whom an event is about: of the people named the last, both of two who collaborate, else the user."""
    people = [n for n, k in entities(f) if n != SELF[0] and n not in NO_SUBJECT and (k == "person" or k == "concept" and re.fullmatch(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", n))]
    if len(people) >= 2 and "collaborat" in f.fact.lower():
        return " and ".join(sorted(people))
    return people[-1] if people else SELF[0] if re.search(r"\buser\b", f.fact, AI) else None


def anchors(f: Fact, recorded: str | None, event: str | None) -> list[Fact]:
    """Facts that name an event and its day.  recorded: the day the fact was recorded, as written; event: the event's, in words."""
    who = subject(f)
    if not recorded or not event or not who or _ANCHORED.search(f.fact):
        return []
    low = f.fact.lower()
    labels = [name for name, groups in EVENTS if all(any(w in low for w in g) for g in groups)]
    labels = [name for name in labels if EXCLUDES.get(name) not in labels]
    return [Fact(f"As of {recorded}, event anchor {x} for {who} occurred on {event}.", "knowledge", max(f.importance, 0.85), (*x.split("."), x, who, event)) for x in labels]


# Quoted titles -----------------------------------------------------------------------------------

_QUOTES = tuple(re.compile(p, A) for p in (r"\"([^\"]{2,80})\"", "“([^”]{2,80})”", "'([^']{2,80})'", "‘([^’]{2,80})’"))
_BOOK, _FAVOURITE = re.compile(r"\b(?:book|books|read|reading)\b", AI), re.compile(r"\bfavou?rite\b", AI)
_OPENING = re.compile(r"\s*[\"'“‘]([^\"'”’]{2,80})[\"'”’]\s*[-:]", A)
_PERFORMED = re.compile(rf"\b(?:{PERFORMED})\b", AI)
_CONCERTS = (re.compile(rf"\bat\s+(?:a\s+)?({NAME}(?:\s+{NAME}){{0,4}})\s+concert\b", A), re.compile(rf"\bconcert\s+(?:featuring|with)\s+({NAME}(?:\s+{NAME}){{0,4}})\b", A))
_WRITER = rf"\b(?P<writer>Dr\.?\s+{NAME}|{NAME}(?:\s+{NAME}){{0,3}})"
_LETTER = r"\s+(?:writing|write)\s+(?:my|their|the user's)?\s*(?:main\s+)?recommendation letter\b"
_LETTERS = (re.compile(rf"{_WRITER}\s+(?:is|'s|will be|agreed to){_LETTER}", AI), re.compile(rf"{_WRITER}\b[^.]{{0,120}}\.\s*(?:she|he|they)\s*(?:'s| is| are| will be)?{_LETTER}", AI))
_WRITES, _LETTER_WORD = re.compile(r"\b(?:writing|write|wrote|agreed to write)\b", AI), re.compile(r"\brecommendation letter\b", AI)


def quoted(speaker: str, text: str, day: str | None) -> list[Fact]:
    """Titles, performers and letter writers that a turn names word for word.  day: of the session, in words."""
    who = f"As of {day}, {speaker}" if day else speaker
    out = []
    if _BOOK.search(text):
        liked = bool(_FAVOURITE.search(text))
        for title in (m[1].strip() for q in _QUOTES for m in q.finditer(text)):
            out.append(Fact(f'{who} {"favorite childhood book was" if liked else "read"} "{title}".', "preference" if liked else "knowledge", 0.7, ("book", title)))
    opening = _OPENING.match(text)
    performers = [opening[1].strip()] if opening and _PERFORMED.search(text) else []
    performers += [re.sub(r"(?i)\s+(?:last|yesterday|today|tomorrow)$", "", m[1]).strip() for p in _CONCERTS for m in p.finditer(text)]
    out += [Fact(f'{who} saw "{p}" perform music.', "knowledge", 0.7, ("artist", "band", "music", p)) for p in performers if p]
    if _LETTER_WORD.search(text) and _WRITES.search(text) and (m := next((m for p in _LETTERS if (m := p.search(text))), None)):
        name = re.sub(r"(?i)^(?:my|the user's|user's)\s+(?:advisor|mentor|professor)\s+", "", m["writer"])
        name = " ".join(re.sub(r"(?i)\bDr\s+", "Dr. ", name, count=1).split())
        whose = "user's" if speaker.lower() == "user" else f"{speaker}'s"
        out.append(Fact(f"{f'As of {day}, ' if day else ''}{name} is writing {whose} main recommendation letter.", "knowledge", 0.7, ("recommendation letter", name)))
    return list({" ".join(x.fact.lower().split()): x for x in out}.values())


# Table functions ---------------------------------------------------------------------------------


def _fact(fact, kind, importance, terms) -> Fact:
    """Null keywords are derived from the fact."""
    return Fact(fact, kind or "knowledge", 0.5 if importance is None else float(importance), tuple(k for k in (keywords(fact) if terms is None else terms) if k is not None))


def _rows(facts: list[Fact]) -> Iterator[tuple]:
    for n, x in enumerate(facts):
        yield n, x.fact, x.type, x.importance, list(x.keywords)


FACTS = "position int, fact string, type string, importance double, keywords array<string>"


class Keywords:
    def eval(self, fact: str):
        if fact:
            for n, k in enumerate(keywords(fact)):
                yield n, k


class Normalise:
    def eval(self, fact: str, kind: str, importance: float, keywords: list[str]):
        if fact:
            yield from _rows(normalised(_fact(fact, kind, importance, keywords)))


class Entities:
    def eval(self, fact: str, kind: str, importance: float, keywords: list[str]):
        if fact:
            yield from entities(_fact(fact, kind, importance, keywords))


class Relations:
    def eval(self, fact: str, kind: str, importance: float, keywords: list[str]):
        if fact:
            yield from relations(_fact(fact, kind, importance, keywords))


class Anchors:
    def eval(self, fact: str, kind: str, importance: float, keywords: list[str], recorded: str, event: str):
        if fact:
            yield from _rows(anchors(_fact(fact, kind, importance, keywords), recorded, event))


class Quoted:
    def eval(self, speaker: str, text: str, day: str):
        if text:
            yield from _rows(quoted(speaker or "user", text, day))
