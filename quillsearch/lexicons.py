"""Constants and word lists of the search engine, and the description of a catalogue table."""

from __future__ import annotations

from dataclasses import dataclass, field

# Thresholds and weights that results depend on.
FIELD_WEIGHTS = {"title": 3.0, "tags": 2.5, "category": 2.0, "description": 1.0, "url": 0.4}
TF_SATURATION = 1.2
FACET_BOOST, FACET_SELECTIVITY_CAP = 12.0, 1.6
PREFIX_DISCOUNT, PREFIX_DOMINANCE = 0.4, 5
PREFIX_MIN, PREFIX_WINDOW, PREFIX_LIMIT = 3, 400, 24
MAX_QUERY_CHARS, MAX_TOKENS, MAX_RESULTS = 120, 10, 20
RECENCY_BOOST, RECENCY_HALF_LIFE = 0.15, 5.0
MIN_FREQUENCY, MIN_CORRECTABLE, MIN_COMPOUND_PART = 3, 4, 3
EDITS, LOOSE_EDITS, LOOSE_RATIO, LOOSE_MIN_TERM, LOOSE_MIN_QUERY = 2, 3, 0.3, 10, 7
LEXICON_MIN_LEN, LEXICON_MIN_COUNT, LEXICON_MIN_LIFT, LEXICON_TOP = 4, 3, 1.5, 12
HINT_MIN_TOTAL, HINT_MIN_SHARE, VARIANT_MIN_SHARE = 3, 0.5, 0.9
SUGGEST_MIN_CHARS, SUGGEST_LIMIT, SUGGEST_WINDOW = 2, 8, 400
LOG_WEIGHT, TAG_WEIGHT = 1.0, 0.05
BASELINE_CAP, OVER_MATCH = 500, 0.20
SLOT_PRIORITY = {"occasion": 0, "format": 1, "tone": 2, "recipient": 3}


def _lists(text: str) -> dict[str, list[str]]:
    """name: word word ... on each line."""
    return {name.strip(): words.split() for name, words in (line.split(":") for line in text.strip().splitlines())}


def _phrases(text: str) -> dict[str, list[str]]:
    """name: phrase, phrase, ... on each line."""
    return {name.strip(): [p.strip() for p in words.split(",")] for name, words in (line.split(":") for line in text.strip().splitlines())}


# The words that name a tone, a recipient or a format.
TONE = _lists("""
humour: funny humor humour hilarious joke jokes lol comedy comical silly laugh laughs witty meme memes hysterical prank goofy
romantic: romantic romance passion passionate intimate sweetheart darling flirty sensual
heartfelt: heartfelt sincere warm touching emotional meaningful sentimental thoughtful
cute: cute adorable sweet lovely charming
formal: formal professional respectful official corporate
apology: sorry apology apologise apologize forgive regret apologies
sympathy: sympathy condolence condolences grief loss bereavement mourning
""")
RECIPIENT = _lists("""
wife: wife wifey
husband: husband hubby
mother: mother mom mum mommy mummy mama moms mothers
father: father dad daddy papa pop dads fathers
sister: sister sis sisters
brother: brother bro brothers
daughter: daughter daughters
son: son sons
friend: friend friends buddy pal bestie
girlfriend: girlfriend gf
boyfriend: boyfriend bf
boss: boss manager colleague coworker
teacher: teacher professor mentor
grandmother: grandmother grandma granny nana grandmom
grandfather: grandfather grandpa grandad granddad
grandson: grandson grandsons
granddaughter: granddaughter granddaughters
niece: niece nieces
nephew: nephew nephews
cousin: cousin cousins
uncle: uncle uncles
aunt: aunt aunty auntie aunts
couple: couple newlyweds
baby: baby newborn babies
pet: pet dog dogs puppy puppies cat cats kitten
""")
FORMAT = _lists("""
animated: animated animation moving gif
flash: flash swf
musical: musical music song singing sound audio
""")
# Phrases claimed to belong to a month's section; kept only where the catalogue agrees.
HINTS = _phrases("""
ejan: new year, january, chinese new year, republic day
efeb: valentine, valentines, february, rose day, hug day
emar: holi, spring, march, st patrick, patrick, easter
eapr: easter, april, earth day, baisakhi
emay: mother, mothers day, may, memorial day, nurses
ejun: father, fathers day, june, summer
ejul: july, fourth of july, july 4th
eaug: friendship, august, raksha bandhan, rakhi
esep: september, autumn, labor day, grandparents
eoct: halloween, diwali, october, dussehra, boss day
enov: thanksgiving, november, veterans
edec: christmas, xmas, december, new year eve, hanukkah
""")
# Query words that stand for others, and spellings claimed to name one thing.
ALIASES = dict(pair.split("=") for pair in """
bday=birthday bdays=birthday xmas=christmas chistmas=christmas congrats=congratulations anniv=anniversary
thx=thanks ty=thanks pls=please vday=valentine cumpleanos=birthday feliz=happy
""".split())
VARIANTS = dict(pair.split("=") for pair in """
deepavali=diwali dipavali=diwali deepawali=diwali chanukah=hanukkah chanukkah=hanukkah hannukah=hanukkah
dasara=dussehra dashera=dussehra dussera=dussehra navratri=navaratri shivratri=shivaratri onam=thiruonam
""".split())
# Stop words and synonyms of the baseline engine.
BASELINE_STOP_WORDS = """
a an and animated any e es anyone as at beautiful but by card cards day de e-card e-cards e-greetings e-wish ecard ecards
egreetings everybody everyone flash for free from gandhian greeting greetings happy image images in into like nor of off on
onto or per popular post postcard postcards printable so some somebody someone the this to top up via wishes wishing with
yet your yours x
""".split()
BASELINE_SYNONYMS = dict(pair.split("=") for pair in """
bday=birthday b'day=birthday mom=mother mommy=mother mama=mother xmas=christmas x-mas=christmas 1st=1 cumpleanos=birthday
""".split())
# Inflectional endings, in the order in which they are tried.
SUFFIXES = "ings ing edly ed ness less fully ful ly es s".split()

CATALOGUE_COLUMNS = """card_number card_title card_description card_tags card_page_url q1_value card_label_type card_created_date
card_music_extn status_id invalid_card card_thumb_extn card_bigimage_extn dev_id""".split()


@dataclass(frozen=True)
class Lexicons:
    """What a catalogue's words mean; the defaults are for greeting cards."""

    tone: dict[str, list[str]] = field(default_factory=lambda: TONE)
    recipient: dict[str, list[str]] = field(default_factory=lambda: RECIPIENT)
    format: dict[str, list[str]] = field(default_factory=lambda: FORMAT)
    hints: dict[str, list[str]] = field(default_factory=lambda: HINTS)
    aliases: dict[str, str] = field(default_factory=lambda: ALIASES)
    variants: dict[str, str] = field(default_factory=lambda: VARIANTS)

    def entries(self) -> list[tuple[str, str, str, int]]:
        """(kind, value, word, order) of each facet word."""
        kinds = (("tone", self.tone), ("recipient", self.recipient), ("format", self.format))
        found = [(kind, value, word) for kind, values in kinds for value, words in values.items() for word in words]
        return [(*e, i) for i, e in enumerate(found)]


#: For tables of widgets (the catalogue made from part): colours and temperatures in the places of recipients and tones.
PART_LEXICONS = Lexicons(tone={"warm": ["hot"], "cool": ["cold"]}, recipient={"red": ["red"], "blue": ["blue"]}, hints={"promo": ["small gear"], "standard": ["hot"]}, aliases={"wee": "small"}, variants={"hot": "cold", "plate": "gear"})
