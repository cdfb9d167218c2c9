"""Word lists about names that are public knowledge, and how a typed name is taken apart."""

from __future__ import annotations

import re
from functools import lru_cache

# Common English given names.
GIVEN_NAMES = """
james robert john michael david william richard joseph thomas christopher charles daniel matthew anthony mark donald
steven andrew paul joshua kenneth kevin brian george timothy ronald jason edward jeffrey ryan jacob nicholas gary eric
jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick frank raymond jack dennis jerry
tyler aaron jose adam nathan henry zachary douglas peter kyle walter ethan jeremy harold keith christian roger gabriel
lawrence orlando philip quentin theodore vincent leonard archibald frederick isaac oscar ulysses victor xavier
mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley
kimberly emily donna michelle carol amanda dorothy melissa deborah stephanie rebecca sharon laura cynthia kathleen amy
angela shirley anna brenda pamela emma nicole helen samantha katherine christine debra rachel carolyn janet catherine
maria heather diane ruth julie olivia joyce virginia victoria kelly lauren christina joan evelyn judith megan andrea
cheryl hannah jacqueline martha gloria teresa abigail ann sara fiona henrietta ingrid isabella matilda eleanor ursula yolanda
""".split()

# Usual short forms of given names.
NICKNAMES = dict(
    pair.split(":")
    for pair in """
abby:abigail archie:archibald ben:benjamin benny:benjamin bill:william billy:william will:william bob:robert bobby:robert
rob:robert chris:christopher kit:christopher cindy:cynthia dot:dorothy dottie:dorothy debbie:deborah deb:deborah
ed:edward eddie:edward ned:edward nell:eleanor ellie:eleanor nora:eleanor liz:elizabeth lizzie:elizabeth beth:elizabeth
betsy:elizabeth etta:henrietta hettie:henrietta fee:fiona fritz:frederick fred:frederick freddie:frederick gabe:gabriel
greg:gregory hal:harold harry:harold inga:ingrid izzy:isabella bella:isabella jake:jacob jen:jennifer jenny:jennifer
joe:joseph joey:joseph kate:katherine kathy:katherine katie:katherine kay:katherine ken:kenneth kenny:kenneth
larry:lawrence lando:orlando leo:leonard len:leonard lenny:leonard livvy:olivia liv:olivia peggy:margaret meg:margaret
maggie:margaret tilly:matilda mattie:matilda mick:michael mike:michael nick:nicholas nicky:nicholas trish:patricia
patty:patricia pip:philip phil:philip quin:quentin ray:raymond sam:samantha sammy:samantha steve:stephen ted:theodore
teddy:theodore theo:theodore tim:timothy timmy:timothy tony:anthony ulla:ursula vicky:victoria tori:victoria
vince:vincent vinny:vincent wally:walter walt:walter yoli:yolanda yola:yolanda zack:zachary zach:zachary
jim:james jimmy:james dan:daniel danny:daniel dave:david matt:matthew rick:richard dick:richard tom:thomas tommy:thomas
andy:andrew josh:joshua ron:ronald jeff:jeffrey jon:jonathan pete:peter alex:alexander hank:henry becky:rebecca
sue:susan suzy:susan barb:barbara pam:pamela angie:angela don:donald drew:andrew frankie:frank gina:regina
""".split()
)

#: Forms of address and degrees that are no part of a name.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir madam rev hon jr sr".split())

#: Legal forms and articles that don't tell companies apart.
LEGAL_FORMS = frozenset("company co corporation corp incorporated inc limited ltd llc plc llp gmbh".split())


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of positions at a time."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    """2 x LCS / (lengths), 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    if len(x) == len(y):
        return x[1:] == y[1:] or (len(x) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])
    return x[1:] == y if len(x) > len(y) else y[1:] == x


@lru_cache(maxsize=100_000)
def known_given(token: str) -> str:
    """The full given name a token stands for (short forms and one typo resolved), or ''."""
    if token in NICKNAMES:
        return NICKNAMES[token]
    if token in _GIVEN:
        return token
    if len(token) >= 4:
        near = sorted({g for g in _GIVEN if abs(len(g) - len(token)) <= 1 and one_edit(token, g) and (len(token) > 4 or g[0] == token[0])})
        if near:
            best = max(near, key=lambda g: (g[0] == token[0], len(g)))
            return NICKNAMES.get(best, best)
    if len(token) >= 3:
        near = sorted({NICKNAMES[n] for n in NICKNAMES if len(n) >= 3 and n[0] == token[0] and abs(len(n) - len(token)) <= 1 and one_edit(token, n)})
        if len(near) == 1:
            return near[0]
    return ""


_GIVEN = frozenset(GIVEN_NAMES)
_TOKEN = re.compile(r"[a-z0-9]+(?:[-'][a-z0-9]+)*|&|,|/|;")


def split_person(text: str) -> tuple[str, str]:
    """(family, given): lower case, titles and middle names dropped; given may be an initial or ''."""
    tokens = [t for t in _TOKEN.findall(text.lower().replace("_", " ")) if t != "&"]
    comma = next((i for i, t in enumerate(tokens) if t in ",/;" and i and i < len(tokens) - 1), 0)
    words = [t for t in tokens if t not in ",/;" and t not in TITLES]
    head = [t for t in tokens[:comma] if t not in ",/;" and t not in TITLES] if comma else []
    long = [w for w in words if len(w) > 1]
    single = [w for w in words if len(w) == 1]
    if not long:
        return "", "".join(words)
    if len(long) == 1:
        return long[0], single[0] if single else ""
    exact = [w for w in long if w in _GIVEN or w in NICKNAMES]
    near = exact or [w for w in long if known_given(w)]
    if len(near) == 1 or (near and not head):
        given = near[0]
    elif head:
        given = next((w for w in long if w not in head), long[0])
    else:
        given = long[0]
    families = [w for w in long if w is not given] or [long[-1]]
    family = head[-1] if head and head[-1] in families else families[-1]
    return family, known_given(given) or given


def split_company(text: str) -> tuple[str, str]:
    """(distinctive word, line of business): lower case, article and legal form dropped, '&' read as 'and'."""
    tokens = ["and" if t == "&" else t for t in _TOKEN.findall(text.lower().replace("_", " ")) if t not in ",/;"]
    words = [t for t in tokens if t not in LEGAL_FORMS]
    if len(words) > 1 and words[0] == "the":
        words = words[1:]
    return (words[0], " ".join(words[1:])) if words else (" ".join(tokens), "")


def same_given(a: str, b: str) -> bool:
    """Given names of one family agree: an initial by the initial, known names if they are equal, others up to a typo (with a
    known name of the same initial, up to two) or as an abbreviation of up to three letters."""
    if not a or not b:
        return False
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    if a in _GIVEN and b in _GIVEN:
        return a == b
    short, long = sorted((a, b), key=len)
    least = 0.7 if a[0] == b[0] and (a in _GIVEN or b in _GIVEN) else 0.8
    return lcs_ratio(a, b) >= least or (len(short) <= 3 < len(long) and a[0] == b[0] and lcs_length(short, long) == len(short))


def same_line(a: str, b: str) -> bool:
    """Lines of business agree word by word: equal, initial, abbreviation in the same letter order, or a typo."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return False
    for p, q in zip(x, y):
        short, long = sorted((p.replace("-", ""), q.replace("-", "")), key=len)
        if short == long:
            continue
        if short[0] == long[0] and (len(short) == 1 or lcs_length(short, long) == len(short)):
            continue
        if lcs_ratio(short, long) < 0.8:
            return False
    return True
