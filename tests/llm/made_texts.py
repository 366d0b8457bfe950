"""Made-up texts in made-up languages, for several test modules."""

import random

SYLLABLES = {"en": "th er ing the and of tion on".split(), "de": "sch ung ich der und ein keit ver".split(), "fr": "eau que les aux oui tre ment ai".split(), "es": "ción los que ando ez ll ia do".split(), "xx": "zk qv wx kq vz".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(seed=0, n=40, langs=("en", "de", "fr", "es", "xx")):
    rng = random.Random(seed)
    spoken = [lang for lang in langs for _ in range(n)]
    return [speak(rng, lang, rng.randint(8, 60)) for lang in spoken], spoken
