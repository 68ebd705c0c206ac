"""Word lists and weights that results depend on."""

STOPWORDS = {
    "en": "a an the and or but is are was were be been am do does did have has had i you he she it we they me my your his her our their this that these those to of in on at for with from not no so if then than as by about out up down over",
    "es": "el la los las un una unos unas de del que y o pero es son era eran ser estar he ha han yo tu el ella nosotros ellos me mi tu su nuestro este esta esos a en por con para sin no si mas como sobre desde hasta muy",
    "fr": "le la les un une des du de que et ou mais est sont etait etaient etre avoir ai a ont je tu il elle nous ils me mon ton son notre ce cette ces a en dans sur pour avec sans ne pas si plus comme depuis jusqu tres",
    "de": "der die das ein eine einen und oder aber ist sind war waren sein haben habe hat hatten ich du er sie wir ihr mein dein sein unser dieser diese dieses zu in an auf für mit von ohne nicht kein wenn dann als wie sehr",
    "pt": "o a os as um uma uns umas de do da que e ou mas é são era eram ser estar tenho tem têm eu tu ele ela nós eles me meu teu seu nosso este esta esses em por com para sem não se mais como sobre desde até muito",
    "it": "il lo la i gli le un uno una di del che e o ma è sono era erano essere avere ho ha hanno io tu lui lei noi loro mi mio tuo suo nostro questo questa questi a in su per con senza non se più come sopra da molto",
    "nl": "de het een en of maar is zijn was waren hebben heb heeft hadden ik jij hij zij wij zij mij mijn jouw haar ons hun deze dit die dat te in op aan voor met van zonder niet geen als dan zoals sinds tot heel",
}
STOPWORDS = {k: tuple(dict.fromkeys(v.split())) for k, v in STOPWORDS.items()}

FUNCTION_WORDS = tuple(dict.fromkeys((
    "a an the this that these those my your his her its our their i me you he she it we they him them us "
    "is am are was were be been being do does did done have has had having will would shall should can could may might must "
    "and or but so if then than because though although while when where as at by for from in into of off on out over to up with without "
    "about after again against all any before both down during each few more most no nor not now once only other own same some such too very just "
    "there here how what which who whom why"
).split()))

FIRST_PERSON = tuple("i me my mine myself we us our ours ourselves".split())
SPORT_WORDS = tuple(dict.fromkeys((
    "game games race races match matches final finals coach coaching training train trains trained session sessions team teams competition competing compete fight "
    "tournament physio squad lineup line-up warm-up warmup heat heats meet bout kick-off opponent opponents selection selected medal season gym pitch court "
    "track field athlete athletes sport sports play playing played win winning won lose losing lost score scoring start starts starting event tomorrow tonight "
    "weekend saturday sunday week"
).split()))
STATE_WORDS = tuple(dict.fromkeys((
    "feel feels feeling felt nervous nerves ready confident confidence worried worry worrying sleep sleeping slept think thinking thought know knowing want wanting "
    "hope hoping calm tired tiredness head mind focus focused focusing pressure stress stressed scared afraid fear anxious excited prepared honestly honest "
    "truth believe sure unsure doubt doubts"
).split()))

#: Cues for the scoring queries, of words that the test tables hold: (construct, cue, direction, magnitude).
#: Directions: 1 raises the index, -1 lowers it, 0 is polar.
CUES = (
    ("worry", "the", 1, 1.5),
    ("worry", "of the", 1, 1.5),
    ("calm", "and", -1, 1.0),
    ("calm", "with", -1, 1.0),
    ("drive", "for", 0, 1.0),
    ("drive", "to the", 0, 1.0),
    ("strain", "que", 1, 1.0),
    ("strain", "der", 1, 1.0),
)

#: Abbreviations that end in a full stop.
ABBREVIATIONS = frozenset("dr mr mrs ms prof sr jr st vs etc no approx dept univ fig al inc ltd co e.g i.e a.m p.m u.s u.k".split())

#: De-identification of contacts, dates and quasi-identifiers: (kind, pattern), applied in order. Patterns avoid look-around
#: where a plain form serves, so that other engines give the same result.
DEID = (
    ("URL", r"(?i)(https?://|www\.)[^\s]+"),
    ("CONTACT", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("HANDLE", r"@[A-Za-z0-9][A-Za-z0-9_.]+"),
    ("CONTACT", r"\+?[0-9]([ ().-]*[0-9]){8,}"),
    ("EVENT_WINDOW", r"(?i)([0-9]{1,2} )?(january|february|march|april|june|july|august|september|october|november|december) [0-9]{1,4}"),
    ("ID", r"(?i)(number|no\.|#) ?[0-9]{1,3}"),
)

#: Fixed values of the de-identification cascade: placeholders, and the cues that type them.
PLACEHOLDERS = tuple("ATHLETE COACH TEAMMATE OPPONENT PERSON HANDLE CONTACT URL TEAM ORG LOCATION EVENT EVENT_WINDOW ID".split())
ROLE_KINDS = {"coach": "COACH", "gaffer": "COACH", "manager": "COACH", "captain": "TEAMMATE", "skipper": "TEAMMATE", "teammate": "TEAMMATE"}
ROLE_NOUNS = frozenset(
    "agent boss captain chef coach dietician doctor gaffer keeper manager mentor nutritionist partner physician physio physiotherapist psych psychologist skipper "
    "teammate therapist trainer".split()
)
WEEKDAYS = frozenset("monday tuesday wednesday thursday friday saturday sunday".split())
MONTHS = tuple("january february march april may june july august september october november december".split())
MONTH_SHORT = tuple("jan feb mar apr jun jul aug sep sept oct nov dec".split())
UNITS = frozenset(
    "second seconds sec secs minute minutes min mins hour hours metre metres meter meters m km mile miles yard yards kilo kilos kg lb lbs pound pounds rep reps set "
    "sets lap laps length lengths degree degrees percent kmh mph point points".split()
)
ORDINALS = tuple("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split())
#: What the last word of a run of two or more capitalised words makes of it.
RUN_ENDS = {
    "LOCATION": frozenset("arena stadium ground grounds park centre center complex court courts field oval pool track velodrome gym gymnasium hall dome bowl".split()),
    "EVENT": frozenset("invitational championship championships open cup cups games series trials classic masters league grand prix marathon meet nationals olympics regionals worlds".split()),
    "TEAM": frozenset("academy athletic athletics club fc harriers hurricanes lions rangers rovers runners stars striders swifts titans united wanderers warriors wolves".split()),
    "ORG": frozenset("apparel association college corporation federation foundation group gmbh inc institute ltd nutrition plc polytechnic school society sportswear trust university".split()),
}
LOCATION_CUES = frozenset(
    "arrive arrived arriving based drive drove fly flew flown flying head heading land landed live lived moving moved relocate relocated travel travelled traveled travelling".split()
)
OPPONENT_CUES = frozenset("against beat beaten beating drawn face faced facing lose losing lost outrun play playing".split())
TITLES = frozenset("coach dr mr mrs ms miss prof professor sir captain capt".split())
SPEECH_VERBS = frozenset("said says told adds added confirmed insisted admitted explained revealed announced".split())
HEALTH_STRONG = frozenset(
    "acl mcl aneurysm appendicitis arthritis asthma bipolar bursitis cancer concussion diabetes diagnosed diagnosis dislocated dislocation epilepsy fracture fractured "
    "hernia mri prescribed prescription reconstruction rehab rehabilitation surgeon surgery surgical tendonitis tendinitis ultrasound "
    "adderall amitriptyline citalopram codeine cortisone diazepam escitalopram fluoxetine gabapentin ibuprofen ketorolac lithium melatonin naproxen paroxetine prednisone "
    "propranolol sertraline tramadol venlafaxine zopiclone".split()
)
HEALTH_WEAK = frozenset("inflammation infection operated operation scan strain strained tear therapy torn".split())
HEALTH_NEAR = frozenset(
    "achilles ankle arm arms back calf calves chest elbow foot feet finger fingers groin hand hands hamstring head heart hip hips knee knees leg legs muscle neck quad quads "
    "ribs shoulder shoulders stomach thigh throat toe wrist appointment clinic consultant dose doctor hospital medication physio scan specialist treatment".split()
)
