"""The phrase dictionaries: what is dropped or shortened, with confidence and category."""

from __future__ import annotations

from dataclasses import dataclass

# Fillers, as (phrase, replacement, confidence, category); without a replacement the phrase goes. The entries, their order, confidences and categories must be these for the results to be right.
FILLERS = [
    ("so i've been meaning to ask", "", 0.8, "preamble"),
    ("i've been meaning to ask", "", 0.75, "preamble"),
    ("i just wanted to say that", "", 0.9, "preamble"),
    ("i just wanted to", "", 0.9, "preamble"),
    ("i was just wondering if", "", 0.85, "preamble"),
    ("i was wondering if", "", 0.85, "preamble"),
    ("i wanted to ask if", "", 0.85, "preamble"),
    ("i wanted to ask", "", 0.85, "preamble"),
    ("i was hoping you could", "", 0.8, "preamble"),
    ("i was hoping to", "", 0.8, "preamble"),
    ("what i want to do is", "", 0.8, "preamble"),
    ("what i am trying to do is", "", 0.8, "preamble"),
    ("what i'm trying to do is", "", 0.8, "preamble"),
    ("so basically what i need is", "", 0.8, "preamble"),
    ("so what i need is", "", 0.8, "preamble"),
    ("i need you to", "", 0.7, "preamble"),
    ("can you please", "", 0.65, "preamble"),
    ("could you please", "", 0.65, "preamble"),
    ("i would like you to", "", 0.7, "preamble"),
    ("i'd like you to", "", 0.7, "preamble"),
    ("i was thinking maybe", "", 0.8, "preamble"),
    ("i was wondering", "", 0.8, "preamble"),
    ("hey so you could", "could you", 0.8, "preamble"),
    ("could you just", "could you", 0.8, "preamble"),
    ("maybe we could just", "could we", 0.8, "preamble"),
    ("maybe we could", "could we", 0.7, "preamble"),
    ("hey can you help me with", "", 0.8, "preamble"),
    ("in order to", "to", 0.95, "connector"),
    ("in order for", "for", 0.95, "connector"),
    ("due to the fact that", "because", 0.95, "connector"),
    ("owing to the fact that", "because", 0.95, "connector"),
    ("by virtue of the fact that", "because", 0.9, "connector"),
    ("for the purpose of", "to", 0.9, "connector"),
    ("with the purpose of", "to", 0.9, "connector"),
    ("at this point in time", "now", 0.95, "connector"),
    ("at the present time", "now", 0.95, "connector"),
    ("at this moment", "now", 0.9, "connector"),
    ("on a daily basis", "daily", 0.95, "connector"),
    ("on a regular basis", "regularly", 0.95, "connector"),
    ("on a weekly basis", "weekly", 0.95, "connector"),
    ("a large number of", "many", 0.85, "connector"),
    ("a number of", "several", 0.8, "connector"),
    ("in the event that", "if", 0.95, "connector"),
    ("in the case that", "if", 0.9, "connector"),
    ("in spite of the fact that", "although", 0.9, "connector"),
    ("regardless of the fact that", "although", 0.9, "connector"),
    ("with regard to", "regarding", 0.9, "connector"),
    ("with regards to", "regarding", 0.9, "connector"),
    ("in regard to", "regarding", 0.9, "connector"),
    ("in regards to", "regarding", 0.9, "connector"),
    ("with respect to", "regarding", 0.85, "connector"),
    ("as a result of", "because of", 0.85, "connector"),
    ("for the reason that", "because", 0.9, "connector"),
    ("has the ability to", "can", 0.95, "connector"),
    ("is able to", "can", 0.9, "connector"),
    ("make a decision", "decide", 0.9, "connector"),
    ("take into consideration", "consider", 0.9, "connector"),
    ("take into account", "consider", 0.85, "connector"),
    ("give an indication of", "indicate", 0.9, "connector"),
    ("is indicative of", "indicates", 0.85, "connector"),
    ("it is important to note that", "", 0.8, "connector"),
    ("it is worth noting that", "", 0.8, "connector"),
    ("it should be noted that", "", 0.8, "connector"),
    ("the reason why is because", "because", 0.95, "redundancy"),
    ("the reason is because", "because", 0.95, "redundancy"),
    ("the reason why", "why", 0.85, "redundancy"),
    ("each and every", "every", 0.95, "redundancy"),
    ("first and foremost", "first", 0.85, "redundancy"),
    ("each and every one", "each", 0.95, "redundancy"),
    ("basic fundamentals", "fundamentals", 0.95, "redundancy"),
    ("completely eliminate", "eliminate", 0.9, "redundancy"),
    ("absolutely essential", "essential", 0.9, "redundancy"),
    ("final outcome", "outcome", 0.9, "redundancy"),
    ("end result", "result", 0.85, "redundancy"),
    ("past history", "history", 0.9, "redundancy"),
    ("future plans", "plans", 0.85, "redundancy"),
    ("added bonus", "bonus", 0.9, "redundancy"),
    ("close proximity", "proximity", 0.9, "redundancy"),
    ("still remains", "remains", 0.85, "redundancy"),
    ("completely finished", "finished", 0.9, "redundancy"),
    ("free gift", "gift", 0.9, "redundancy"),
    ("help me out with", "help with", 0.8, "redundancy"),
    ("there might possibly be", "there might be", 0.8, "redundancy"),
    ("the way i want it to", "properly", 0.7, "redundancy"),
    ("working the way i want it to", "working", 0.8, "redundancy"),
    ("but dont make it too complicated", "", 0.7, "redundancy"),
    ("just curious", "", 0.6, "filler"),
    ("just checking", "", 0.6, "filler"),
    ("basically", "", 0.7, "filler"),
    ("essentially", "", 0.65, "filler"),
    ("actually", "", 0.6, "filler"),
    ("literally", "", 0.7, "filler"),
    ("honestly", "", 0.65, "filler"),
    ("obviously", "", 0.6, "filler"),
    ("clearly", "", 0.55, "filler"),
    ("really", "", 0.5, "filler"),
    ("very", "", 0.45, "filler"),
    ("just", "", 0.5, "filler"),
    ("quite", "", 0.45, "filler"),
    ("kind of", "", 0.7, "filler"),
    ("sort of", "", 0.7, "filler"),
    ("real quick", "", 0.8, "filler"),
    ("something real quick", "", 0.8, "filler"),
    ("just kind of", "", 0.8, "filler"),
    ("in my opinion", "", 0.9, "hedging"),
    ("in my experience", "", 0.9, "hedging"),
    ("as far as i know", "", 0.9, "hedging"),
    ("i think", "", 0.8, "hedging"),
    ("i believe", "", 0.8, "hedging"),
    ("i feel like", "", 0.7, "hedging"),
    ("possibly", "", 0.8, "hedging"),
    ("perhaps", "", 0.8, "hedging"),
    ("arguably", "", 0.8, "hedging"),
    ("probably", "", 0.8, "hedging"),
    ("maybe", "", 0.6, "hedging"),
    ("when you get a chance", "", 0.75, "polite"),
    ("whenever you get a chance", "", 0.75, "polite"),
    ("no rush but", "", 0.7, "polite"),
    ("if that makes sense", "", 0.9, "polite"),
    ("if that helps", "", 0.85, "polite"),
    ("hope that helps", "", 0.9, "polite"),
    ("hope this helps", "", 0.9, "polite"),
    ("thanks in advance", "", 0.8, "polite"),
    ("thank you in advance", "", 0.8, "polite"),
    ("sorry to bother you but", "", 0.85, "polite"),
    ("sorry to bother you", "", 0.85, "polite"),
    ("sorry for the long message but", "", 0.8, "polite"),
    ("sorry for the long message", "", 0.8, "polite"),
    ("i apologize if this is a dumb question but", "", 0.9, "polite"),
    ("i apologize if this is a stupid question but", "", 0.9, "polite"),
    ("let me know if you have any questions", "", 0.75, "polite"),
    ("please let me know", "", 0.6, "polite"),
    ("not sure if this is the right place to ask but", "", 0.85, "polite"),
    ("i don't know if this is the right way to ask but", "", 0.85, "polite"),
    ("if that's okay", "", 0.85, "polite"),
    ("if that is okay", "", 0.85, "polite"),
    ("thanks so much", "thanks", 0.85, "polite"),
    ("i really appreciate it", "", 0.8, "polite"),
    ("i would really appreciate it", "", 0.8, "polite"),
    ("anyway", "", 0.6, "conversational"),
    ("anyways", "", 0.6, "conversational"),
    ("you know?", "", 0.75, "conversational"),
    ("you know,", ",", 0.65, "conversational"),
    ("so the thing is", "", 0.85, "conversational"),
    ("the thing is", "", 0.8, "conversational"),
    ("the point is", "", 0.7, "conversational"),
    ("to be honest", "", 0.7, "conversational"),
    ("to be fair", "", 0.6, "conversational"),
    ("as you can see", "", 0.8, "conversational"),
    ("as you know", "", 0.75, "conversational"),
    ("as i mentioned", "", 0.7, "conversational"),
    ("as i said before", "", 0.75, "conversational"),
    ("as i was saying", "", 0.75, "conversational"),
    ("having said that", "", 0.6, "conversational"),
    ("that being said", "", 0.6, "conversational"),
    ("with that being said", "", 0.65, "conversational"),
    ("long story short", "", 0.7, "conversational"),
    ("to make a long story short", "", 0.75, "conversational"),
    ("needless to say", "", 0.8, "conversational"),
    ("it goes without saying that", "", 0.85, "conversational"),
    ("at the end of the day", "", 0.7, "conversational"),
    ("when all is said and done", "", 0.75, "conversational"),
    ("all things considered", "", 0.6, "conversational"),
]

# Boilerplate, likewise. The entries, their order, confidences and categories must be these for the results to be right.
BOILERPLATE = [
    ("make sure the code is clean and well-organized", "", 0.95, "ai_implicit"),
    ("make sure the code is clean and well organized", "", 0.95, "ai_implicit"),
    ("make sure the code is clean", "", 0.9, "ai_implicit"),
    ("write clean and maintainable code", "", 0.95, "ai_implicit"),
    ("write clean code", "", 0.9, "ai_implicit"),
    ("use modern best practices", "", 0.95, "ai_implicit"),
    ("follow best practices", "", 0.9, "ai_implicit"),
    ("use best practices", "", 0.9, "ai_implicit"),
    ("handle all edge cases", "", 0.85, "ai_implicit"),
    ("handle edge cases", "", 0.85, "ai_implicit"),
    ("make it production ready", "", 0.85, "ai_implicit"),
    ("make it production-ready", "", 0.85, "ai_implicit"),
    ("add proper error handling", "", 0.85, "ai_implicit"),
    ("add error handling", "", 0.8, "ai_implicit"),
    ("make sure it works correctly", "", 0.95, "ai_implicit"),
    ("make sure it works", "", 0.9, "ai_implicit"),
    ("optimize for performance", "", 0.8, "ai_implicit"),
    ("follow coding standards", "", 0.9, "ai_implicit"),
    ("use proper naming conventions", "", 0.9, "ai_implicit"),
    ("add comments where necessary", "", 0.85, "ai_implicit"),
    ("add appropriate comments", "", 0.85, "ai_implicit"),
    ("make the code readable", "", 0.9, "ai_implicit"),
    ("write readable code", "", 0.9, "ai_implicit"),
    ("ensure type safety", "", 0.8, "ai_implicit"),
    ("make it scalable", "", 0.75, "ai_implicit"),
    ("ensure it is secure", "", 0.7, "ai_implicit"),
    ("make sure it is efficient", "", 0.85, "ai_implicit"),
    ("use descriptive variable names", "", 0.9, "ai_implicit"),
    ("keep it simple and clean", "", 0.85, "ai_implicit"),
    ("keep it simple", "", 0.7, "ai_implicit"),
    ("keep the code dry", "", 0.85, "ai_implicit"),
    ("avoid code duplication", "", 0.85, "ai_implicit"),
    ("make it reusable", "", 0.75, "ai_implicit"),
    ("make the code modular", "", 0.8, "ai_implicit"),
    ("i want you to act as", "", 0.85, "meta_instruction"),
    ("you are an expert in", "", 0.8, "meta_instruction"),
    ("you are an expert", "", 0.75, "meta_instruction"),
    ("your task is to", "", 0.8, "meta_instruction"),
    ("your job is to", "", 0.8, "meta_instruction"),
    ("i need you to help me", "", 0.8, "meta_instruction"),
    ("please provide a detailed", "provide", 0.7, "meta_instruction"),
    ("please provide a comprehensive", "provide", 0.7, "meta_instruction"),
    ("i need a detailed explanation of", "explain", 0.7, "meta_instruction"),
    ("as an ai language model", "", 0.95, "meta_instruction"),
    ("as a large language model", "", 0.95, "meta_instruction"),
    ("you should know that", "", 0.8, "meta_instruction"),
    ("keep in mind that", "", 0.6, "meta_instruction"),
    ("remember that", "", 0.55, "meta_instruction"),
    ("please note that", "", 0.6, "meta_instruction"),
    ("make it look professional", "", 0.75, "quality_platitude"),
    ("make it look good", "", 0.7, "quality_platitude"),
    ("make it look nice", "", 0.7, "quality_platitude"),
    ("make it user-friendly", "", 0.7, "quality_platitude"),
    ("make it user friendly", "", 0.7, "quality_platitude"),
    ("make it intuitive", "", 0.7, "quality_platitude"),
    ("make the ui clean and modern", "", 0.7, "quality_platitude"),
    ("make the ui look modern", "", 0.7, "quality_platitude"),
    ("with a good user experience", "", 0.75, "quality_platitude"),
    ("with good ux", "", 0.75, "quality_platitude"),
    ("the code should be well-tested", "", 0.8, "quality_platitude"),
    ("the code should be well tested", "", 0.8, "quality_platitude"),
    ("please test it thoroughly", "", 0.85, "quality_platitude"),
    ("it should work well", "", 0.9, "quality_platitude"),
    ("it needs to work properly", "", 0.9, "quality_platitude"),
    ("that would be great", "", 0.85, "sign_off"),
    ("that would be really helpful", "", 0.85, "sign_off"),
    ("that would be awesome", "", 0.85, "sign_off"),
    ("i would really appreciate your help", "", 0.9, "sign_off"),
    ("i would appreciate your help", "", 0.85, "sign_off"),
    ("any help would be appreciated", "", 0.85, "sign_off"),
    ("looking forward to your response", "", 0.9, "sign_off"),
    ("looking forward to hearing from you", "", 0.9, "sign_off"),
    ("let me know what you think", "", 0.7, "sign_off"),
    ("let me know if that works", "", 0.75, "sign_off"),
    ("does that make sense", "", 0.85, "sign_off"),
]

# Shortenings, likewise. The entries, their order, confidences and categories must be these for the results to be right.
SHORTENINGS = [
    ("application", "app", 0.9, "tech_terms"),
    ("applications", "apps", 0.9, "tech_terms"),
    ("implementation", "impl", 0.85, "tech_terms"),
    ("implementations", "impls", 0.85, "tech_terms"),
    ("configuration", "config", 0.9, "tech_terms"),
    ("configurations", "configs", 0.9, "tech_terms"),
    ("documentation", "docs", 0.9, "tech_terms"),
    ("authentication", "auth", 0.9, "tech_terms"),
    ("authorization", "authz", 0.85, "tech_terms"),
    ("environment", "env", 0.85, "tech_terms"),
    ("environments", "envs", 0.85, "tech_terms"),
    ("repository", "repo", 0.9, "tech_terms"),
    ("repositories", "repos", 0.9, "tech_terms"),
    ("dependencies", "deps", 0.9, "tech_terms"),
    ("dependency", "dep", 0.85, "tech_terms"),
    ("development", "dev", 0.8, "tech_terms"),
    ("database", "DB", 0.85, "tech_terms"),
    ("databases", "DBs", 0.85, "tech_terms"),
    ("parameters", "params", 0.9, "tech_terms"),
    ("parameter", "param", 0.9, "tech_terms"),
    ("directory", "dir", 0.9, "tech_terms"),
    ("directories", "dirs", 0.9, "tech_terms"),
    ("navigation", "nav", 0.85, "tech_terms"),
    ("information", "info", 0.85, "tech_terms"),
    ("functionality", "features", 0.8, "tech_terms"),
    ("specification", "spec", 0.85, "tech_terms"),
    ("specifications", "specs", 0.85, "tech_terms"),
    ("properties", "props", 0.85, "tech_terms"),
    ("components", "comps", 0.75, "tech_terms"),
    ("administration", "admin", 0.9, "tech_terms"),
    ("administrator", "admin", 0.9, "tech_terms"),
    ("temporary", "temp", 0.8, "tech_terms"),
    ("arguments", "args", 0.9, "tech_terms"),
    ("argument", "arg", 0.9, "tech_terms"),
    ("command line", "CLI", 0.8, "tech_terms"),
    ("user interface", "UI", 0.9, "tech_terms"),
    ("application programming interface", "API", 0.95, "tech_terms"),
    ("do not", "don't", 0.95, "contraction"),
    ("does not", "doesn't", 0.95, "contraction"),
    ("did not", "didn't", 0.95, "contraction"),
    ("is not", "isn't", 0.95, "contraction"),
    ("are not", "aren't", 0.95, "contraction"),
    ("was not", "wasn't", 0.95, "contraction"),
    ("were not", "weren't", 0.95, "contraction"),
    ("will not", "won't", 0.95, "contraction"),
    ("would not", "wouldn't", 0.95, "contraction"),
    ("could not", "couldn't", 0.95, "contraction"),
    ("should not", "shouldn't", 0.95, "contraction"),
    ("can not", "can't", 0.95, "contraction"),
    ("cannot", "can't", 0.95, "contraction"),
    ("have not", "haven't", 0.9, "contraction"),
    ("has not", "hasn't", 0.9, "contraction"),
    ("had not", "hadn't", 0.9, "contraction"),
    ("it is", "it's", 0.8, "contraction"),
    ("it has", "it's", 0.75, "contraction"),
    ("that is", "that's", 0.8, "contraction"),
    ("there is", "there's", 0.8, "contraction"),
    ("there are", "there're", 0.7, "contraction"),
    ("i am", "I'm", 0.9, "contraction"),
    ("i have", "I've", 0.9, "contraction"),
    ("i will", "I'll", 0.9, "contraction"),
    ("i would", "I'd", 0.9, "contraction"),
    ("we are", "we're", 0.85, "contraction"),
    ("we have", "we've", 0.85, "contraction"),
    ("we will", "we'll", 0.85, "contraction"),
    ("you are", "you're", 0.85, "contraction"),
    ("you have", "you've", 0.85, "contraction"),
    ("you will", "you'll", 0.85, "contraction"),
    ("they are", "they're", 0.85, "contraction"),
    ("they have", "they've", 0.85, "contraction"),
    ("they will", "they'll", 0.85, "contraction"),
    ("approximately", "approx", 0.85, "verbose_phrase"),
    ("for example", "e.g.", 0.85, "verbose_phrase"),
    ("that is to say", "i.e.", 0.9, "verbose_phrase"),
    ("and so on", "etc.", 0.85, "verbose_phrase"),
    ("and so forth", "etc.", 0.85, "verbose_phrase"),
    ("and more", "etc.", 0.7, "verbose_phrase"),
    ("as well as", "&", 0.7, "verbose_phrase"),
    ("in addition to", "+", 0.65, "verbose_phrase"),
    ("with the exception of", "except", 0.9, "verbose_phrase"),
    ("on the other hand", "conversely", 0.8, "verbose_phrase"),
    ("as a matter of fact", "in fact", 0.9, "verbose_phrase"),
]

# Swaps, which have neither confidence nor category. The entries, their order, confidences and categories must be these for the results to be right.
SWAPS = [
    ("approximately", "~"),
    ("prerequisite", "prereq"),
    ("nevertheless", "still"),
    ("unfortunately", "sadly"),
    ("characteristics", "traits"),
    ("straightforward", "simple"),
    ("comprehensive", "full"),
    ("alternatively", "or"),
    ("modification", "change"),
    ("modifications", "changes"),
    ("utilization", "use"),
    ("significantly", "greatly"),
    ("simultaneously", "at once"),
    ("corresponding", "matching"),
    ("specifically", "namely"),
    ("consequently", "thus"),
    ("requirements", "needs"),
    ("demonstrate", "show"),
    ("illustrate", "show"),
    ("facilitate", "ease"),
    ("sufficient", "enough"),
    ("subsequent", "next"),
    ("additional", "extra"),
    ("frequently", "often"),
    ("initially", "first"),
    ("ultimately", "finally"),
    ("furthermore", "also"),
]

# Words that are never touched, and phrases that depend on their context.
NEVER_TOUCH = "might likely unlikely may could should would".split()
CONTEXT_SENSITIVE = ["keep in mind that", "remember that", "please note that", "keep it simple"]


@dataclass(frozen=True)
class Entry:
    kind: str
    seq: int
    phrase: str
    replacement: str
    confidence: float | None
    category: str | None


def entries(kind: str, rows: list[tuple]) -> list[Entry]:
    return [Entry(kind, i, *row, *(None,) * (4 - len(row))) for i, row in enumerate(rows)]


ENTRIES = {"filler": entries("filler", FILLERS), "boilerplate": entries("boilerplate", BOILERPLATE), "shortening": entries("shortening", SHORTENINGS), "swap": entries("swap", SWAPS)}


def context_sensitive(phrase: str) -> bool:
    """Does it depend on what stands around a phrase whether it may go?"""
    return phrase.lower() in CONTEXT_SENSITIVE


def threshold(kind: str, level: float) -> float:
    """Least confidence at a level of aggressiveness; in binary floating point, so that entries right at it fall as they should."""
    return max(0.1, 1.1 - level / 4) if kind == "boilerplate" else max(0.0, 1 - level / 5)


def active(kind: str, level: float, hedging: bool = True, excluded: frozenset[str] = frozenset()) -> list[Entry]:
    """Entries in use: above the threshold, not excluded (swaps can't be), hedges only if asked for."""
    if kind == "swap":
        return list(ENTRIES[kind])
    least = threshold(kind, level)
    return [e for e in ENTRIES[kind] if e.confidence >= least and (hedging or e.category != "hedging") and e.phrase.lower() not in excluded and e.phrase not in NEVER_TOUCH]


def longest_first(*lists: list[Entry]) -> list[Entry]:
    return sorted((e for entries in lists for e in entries), key=lambda e: -len(e.phrase))
