"""Scores for abusive, hateful or sexually explicit language."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- folding ----------------------------------------------------------------------

# Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = dict(zip("абвгеёзийклмнорстухіјѕԁһѵԝӏαβγεικνορτυχω", "a6breeзийkлмнopctyxijsdhvwlabyeikvoptuxw"))
_SIGNS = {"@": "a", "4": "a", "$": "s", "5": "s", "0": "o", "1": "i", "!": "i", "|": "l", "3": "e", "7": "t", "8": "b", "9": "g", "6": "g", "+": "t", "€": "e", "£": "l", "¢": "c"}
_OTHER_ONE = {"1": "l", "!": "l"}  # the other letter these may stand for
_HIDDEN = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff"
_TABLE = {ord(a): b for a, b in _LOOKALIKES.items()} | dict.fromkeys(map(ord, _HIDDEN)) | {ord("\u2019"): "'", ord("\u2018"): "'", ord("ß"): "ss", ord("ø"): "o", ord("ł"): "l", ord("ı"): "i"}
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20f0\ufe20-\ufe2f]+")
_MASKED = re.compile(r"(?<![\w@$!|+*€£])(?=[a-z]*[@$!|+*0-9€£])[a-z@$!|+*0-9€£]*[a-z][a-z@$!|+*0-9€£]*")
_HAS_SIGN = re.compile(r"[a-z][@$!|+*0-9€£]|[@$!|+*0-9€£][a-z]")
_SPACED = re.compile(r"(?<![^\W_])[a-z](?:([ .\-_*])[a-z](?![^\W_]))(?:\1[a-z](?![^\W_]))+")
_GAP = re.compile(r"(?<=\w)[^\S\n]{6,}(?=\w)")
_RUN = re.compile(r"([a-z])\1{2,}")
_END = re.compile(r"[.!?…]+(?=[\s\"')\]]|$)|[\n\r]+")
_REST = re.compile(r" ?(?:[^\w\n ]|_)(?:[^\w\n]|_)*| {2,}")
_TRIPLES = [3 * chr(c) for c in range(ord("a"), ord("z") + 1)]
_PLAIN = bytes(c if chr(c).isalnum() or c == 10 else 32 for c in range(128)) + bytes(128)
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _TABLE) + "]")


def _unmask(m: re.Match) -> str:
    word = m.group()
    if len(word) > 24 or word.isalpha() or not _HAS_SIGN.search(word):
        return word
    body = word.rstrip("!")  # an exclamation, not a letter
    tail = word[len(body) :]
    if "*" in body:
        return masked_words().get((body[0], len(body), body[-1]), body) + tail if len(body.strip("*")) >= 2 else body + tail
    if body.isalpha() or not body:
        return word
    letters = sum(ch.isalpha() for ch in body)
    if 2 * letters < len(body):
        return word
    folded = "".join(_SIGNS.get(ch, ch) for ch in body)
    if folded not in single_words():
        other = "".join(_OTHER_ONE.get(ch) or _SIGNS.get(ch, ch) for ch in body)
        folded = other if other in single_words() else folded
    return folded + tail


def fold(text: str) -> str:
    """Lower-case words parted by single blanks, passages by line feeds.

    Undoes compatibility forms, accents, look-alike letters, hidden signs, signs
    and digits within words, masked letters, letters written apart and letters
    repeated three times or more.
    """
    if not text.isascii():
        text = _ODD.sub(lambda m: _TABLE[ord(m.group())] or "", _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold())
    else:
        text = text.lower()
    text = _SPACED.sub(lambda m: m.group().replace(m.group(1), ""), text)
    if _HAS_SIGN.search(text):
        text = _MASKED.sub(_unmask, text)
    if any(x in text for x in _TRIPLES):
        text = _RUN.sub(r"\1", text)
    text = _END.sub(" \n ", text)
    if text.isascii():
        text = text.encode("ascii").translate(_PLAIN).decode("ascii")
    else:
        text = _REST.sub(" ", text)
    return " " + " \n ".join(" ".join(p.split()) for p in text.split("\n")) + " "


# --- lexicon ----------------------------------------------------------------------

ABUSE, THREAT, HATE, SEXUAL = "abusive", "threat", "hateful", "sexual"

# Parts of speech of offence, from which the lexicon is made. In a pattern, ``(a|b)``
# stands for either, an empty choice for nothing and ``{NAME}`` for the words listed here;
# it is expanded to phrases.
PARTS = {
    "PROFANE": "asshole assholes arsehole arseholes bastard bastards scumbag scumbags motherfucker motherfuckers dickhead dickheads shithead shitheads cunt cunts bitch bitches dipshit dipshits fuckwit fuckwits fucktard wanker wankers tosser tossers twat twats douchebag douchebags douche jackass jackasses dumbass dumbasses prick pricks bellend knobhead arsewipe asswipe shitbag shitbags fuckface cocksucker cocksuckers sonofabitch slimeball slimeballs sleazebag sleazebags dirtbag dirtbags turd turds",
    "NOUN": "idiot idiots moron morons imbecile imbeciles cretin cretins scum lowlife lowlifes degenerate degenerates buffoon buffoons bozo bozos simpleton simpletons halfwit halfwits dimwit dimwits nitwit nitwits numbskull numbskulls blockhead blockheads dunce dunces crook crooks creep creeps pervert perverts psychopath psychopaths nincompoop nincompoops retard douchebags weasel weasels coward cowards bloodsucker bloodsuckers sociopath sociopaths",
    "BEAST": "pig pigs swine rat rats snake snakes toad toads vermin maggot maggots leech leeches parasite parasites cockroach cockroaches worm worms dog dogs vultures hyenas clown clowns trash garbage filth liar liars thief thieves cheats fool fools loser losers jerk jerks hypocrite hypocrites hacks frauds thugs lunatic lunatics dirt retards slime",
    "ADJ": "stupid pathetic worthless spineless useless filthy rotten disgusting miserable lying slimy gutless brainless braindead clueless idiotic moronic dumb dumbest contemptible despicable repulsive vile shameless crooked ugly bloody damn damned goddamn sick fat lazy greedy corrupt dirty thieving cheating disgraceful cowardly retarded imbecilic two-faced good-for-nothing",
    "YOU": "you|you people|you lot|you all|you guys|you bunch of|you pack of|you are|you re|you are all|you re all|you are a|you re a|you are nothing but|you are such|all of you|every one of you|the lot of you|your kind|you useless|you are just|you absolute|you complete|you fucking",
    "WILL": "will|ll|am going to|are going to|re going to|m going to|gonna|should|want to|would love to|swear i will",
    "HARM": "kill|hurt|shoot|stab|strangle|murder|hang|beat|burn|slaughter|butcher|choke|drown|cripple|torture|rape|skin|gut|bury|hunt|punch|whip|poison",
    "WHOM": "you|you all|all of you|every one of you|each of you|him|her|them|them all|your wife|your husband|your kids|your children|your family|your mother|your son|your daughter|your whole family|that bitch",
    "LIMB": "legs|leg|neck|bones|bone|face|skull|head|throat|teeth|jaw|knees|kneecaps|fingers|arms|ribs|spine|nose|brains|guts|heart|eyes|tongue",
    "KIN": "kids|children|family|wife|husband|daughter|son|mother|father|brother|sister|grandchildren|loved ones",
    "BODY": "tits|breasts|boobs|ass|arse|cock|dick|pussy|thighs|nipples|butt|crotch|panties|bra|balls|clit|body|legs|chest|hips",
    "WHOSE": "my|your|her|his|their|those|that|these",
    "GROUP": "immigrants|immigrant|migrants|foreigners|refugees|illegals|muslims|muslim|jews|jew|arabs|mexicans|africans|asians|chinese|indians|pakistanis|turks|russians|poles|blacks|gypsies|gays|lesbians|homosexuals|transsexuals|transgender people|queers|women|woman|girls|females|cripples|disabled people|handicapped|old people|the elderly|pensioners|poor people|the poor|homeless people|believers|unbelievers|christians|catholics|hindus|tribe|tribes|ethnics|natives|peasants|people like that|those people|these people|that sort|that kind|of that race|that race|this race|that religion|this religion|that colour|that color|their kind|your kind|his kind|her kind|people of color|minorities",
    "BEING": "are|is|are all|they are|are nothing but|are no better than|are worse than|are like|like|are just|are only|are a bunch of|are basically",
    "LOW": "animals|animal|rats|vermin|cockroaches|parasites|a disease|a plague|a cancer|a curse|a stain|filth|scum|subhuman|savages|dogs|pigs|apes|monkeys|insects|lice|garbage|trash|dirt|criminals|thieves|liars|rapists|terrorists|leeches|beasts|barbarians|inferior|sewage|maggots|worthless|lazy and stupid|not human|not people",
    "MUST": "should be|should all be|ought to be|must be|need to be|deserve to be|have to be|want to be|better be|get|getting|be",
    "RID": "shot|hanged|gassed|exterminated|wiped out|eradicated|locked up|locked away|thrown out|kicked out|driven out|chased out|burned|burnt|caged|sterilized|sterilised|put down|rounded up|drowned|beaten|whipped|enslaved|castrated|killed|wiped off|banned from work|sent back|shipped back|shipped off|sent home",
}

# Weighted patterns by category. A passage counts from a weight of 3 on: a strong
# term alone, or weaker ones together (an insult and the person it is aimed at).
# The second figure names what counts once a passage: 1 adjectives, 2 being
# addressed, 3 a group being named; 0 each term by itself.
PATTERNS: list[tuple[str, float, int, str]] = [
    (ABUSE, 3, 0, "{PROFANE}"),
    (ABUSE, 3, 0, "({YOU}) ({NOUN}|{BEAST})"),
    (ABUSE, 3, 0, "(you|you all|you people|board|directors|managers|executives|bosses|company) are (the|pure|complete|just|nothing but|such|all|absolute) ({NOUN}|filth|scum|dirt|trash|garbage|vermin|parasites|liars|thieves|fools|swine|pigs|rats)"),
    (ABUSE, 3, 0, "(you|you are|you all) ({ADJ}) ({NOUN}|{BEAST}|people|man|woman)"),
    (ABUSE, 3, 0, "({ADJ}) ({NOUN}|excuse for)"),
    (ABUSE, 3, 0, "(bunch|pack|gang|band|crew|load|collection) of (|{ADJ}) ({NOUN}|liars|thieves|pigs|rats|fools|losers|clowns|hypocrites|cheats|frauds|parasites|jerks)"),
    (ABUSE, 3, 0, "(fuck|screw|damn) (you|your|off|yourself|yourselves|all of you|the lot of you|them all|this company)"),
    (ABUSE, 3, 0, "(fucking|goddamn|bloody) ({NOUN}|{BEAST}|disgrace|disgust|joke|crooks|people|company|useless|stupid)"),
    (ABUSE, 3, 0, "(go to|rot in|burn in|see you in|belong in) hell"),
    (ABUSE, 3, 0, "(full of|piece of|pieces of|pile of|load of|sack of|bag of|eat|talking) shit"),
    (ABUSE, 3, 0, "(waste of) (space|oxygen|air|skin|breath|life)"),
    (ABUSE, 3, 0, "(you|you all|you people|they|he|she) (make|makes) me (sick|puke|vomit|want to puke|want to vomit|want to throw up)"),
    (ABUSE, 3, 0, "(you|you all|you people) disgust me"),
    (ABUSE, 3, 0, "(shut|shut up) your (mouth|face|trap|pie hole|filthy mouth)"),
    (ABUSE, 3, 0, "(shove|stick) (it|that|this|your) (up|where the sun)|shove (this|that|your) (letter|report|dividend|proposal|apology|job|money|offer) (up|down|where)"),
    (ABUSE, 3, 0, "(spit|piss|shit) (on|in) (you|your|your grave|your face|all of you)"),
    (ABUSE, 3, 0, "(kiss|lick) my (ass|arse|boots)|drop dead|go fuck|go screw yourself|brain dead|shit for brains"),
    (ABUSE, 3, 0, "(crawl|slither|get) back (into|under|to) (your|the|whatever) (hole|rock|sewer|gutter|swamp|cave)"),
    (ABUSE, 3, 0, "(nothing but|only) (contempt|disgust|scorn) for (you|your|all of you|you people)|sell (your|their|his|her|its) own (mother|mothers|grandmother|children|kids)"),
    (ABUSE, 3, 0, "(brain|brains|intelligence|iq|spine|backbone|morals) of (a|an) (|dead |rotten )(worm|slug|flea|rat|pig|donkey|monkey|potato|cabbage|brick|goldfish|amoeba|chicken|jellyfish|toad|mosquito|snail)"),
    (ABUSE, 2, 0, "{NOUN}|shit|shitty|bullshit|crap|fucking|fuck|fucked|fucker|fuckers|fuckin|puke|arse|bollocks"),
    (ABUSE, 1.5, 0, "{BEAST}"),
    (ABUSE, 1, 1, "{ADJ}|hate|incompetent|disgust|contempt"),
    (ABUSE, 1, 2, "you|your|you people|you lot|all of you|every one of you|the lot of you|yourselves"),
    (ABUSE, 1, 2, "(he|she|ceo|chairman|chairwoman|boss|manager|director|president|treasurer|cfo|board) is a|(they|directors|managers|executives|bosses|analysts|board members) are"),
    (THREAT, 3, 0, "(i|we) know where (you|your|he|she|they) (live|lives|work|works|sleep|sleeps|park|go|are|stay|{KIN}|office|house|home|car)"),
    (THREAT, 3, 0, "(i|we) have (your|his|her) (|home )address|(i|we) (am|are|m|re) (coming|going to come) for (you|your|him|her|all of you)|coming for you"),
    (THREAT, 3, 0, "(i|we|somebody|someone|he|they) ({WILL}) ({HARM}) ({WHOM})"),
    (THREAT, 3, 0, "({HARM}) (you|yourself|yourselves|all of you|your family|them all|you all|every one of you)"),
    (THREAT, 3, 0, "(break|smash|snap|crush|shatter|slit|cut|rip|tear|bash|wring|split|slash|twist|kick|knock|blow|cave in) (|out |off |open )(your|his|her|their|every) (|damn |fucking |ugly |smug |stupid )({LIMB})"),
    (THREAT, 3, 0, "break every (bone|finger|tooth|limb|window)|beat the (crap|shit|hell|life|daylights) out of|beat you (to|up|with|till|until)"),
    (THREAT, 3, 0, "(you|you all|they|he|she) (will|ll|are going to|re going to|deserve to|should|ought to|must|need to|gonna) (|all |soon |both )(die|bleed|burn|suffer for|scream|rot|beg|choke|hang|be dead|be sorry you|regret the day|regret every|wish you were|pay with)"),
    (THREAT, 3, 0, "(hope|wish|pray) (you|you all|all of you|he|she|they|your family) (|all |both )(die|dies|burn|burns|rot|rots|suffer|suffers|choke|chokes|bleed|get hit|gets hit|get cancer|gets cancer|drop dead|crash)"),
    (THREAT, 3, 0, "(watch your back|watch your step from now|sleep with one eye open|your days are numbered|you are dead|you re dead|dead meat|your time is up|you are next|you re next|never see your (kids|family|children) again|say your prayers|count your days|beg for (mercy|your life)|wish you were (never born|dead)|last (day|days|thing) you will)"),
    (THREAT, 3, 0, "(put|fire|empty) (a|one|some|two) (|few )(bullet|bullets|knife|rounds)|bullet (in|with|for) your"),
    (THREAT, 3, 0, "(burn|blow up|torch|set fire to|bomb|shoot up) (your|his|her|the whole|that|this) (|pretty |nice |damn |fucking )(house|home|car|office|offices|building|headquarters|place|family)|(house|home|car|office|building|headquarters|place) (will|is going to|should) burn|burn (it|you|everything|that place|the place) (down|to the ground|alive)"),
    (THREAT, 3, 0, "your (|whole |little |dear |lovely |precious )({KIN}) (will|ll|is going to|are going to|should|is|are) (pay|suffer|die|bleed|burn|next|not safe|in danger|regret|be sorry|cry)"),
    (THREAT, 3, 0, "(end up|find you|floating|found|dumped|lying) (in|at the bottom of) (|a |the )(ditch|river|trunk|grave|coffin|lake|dumpster|body bag)"),
    (THREAT, 3, 0, "(nobody|no one|they) (will|ll|is going to|will never|will not) (|ever |even )(find|miss|see|hear|recognise|recognize) (you|you again|your body|your bones|your remains|you scream|what is left of (you|him|her|them))"),
    (THREAT, 2, 0, "(you|you all|he|she|they) (will|ll|are going to) (pay for|regret|be sorry|get what you deserve|get what is coming)|(i|we) (will|ll) (find|get|hunt down|destroy|ruin|finish) (you|your|all of you|every one of you)|get cancer|gets cancer|pay with your|(someone|somebody) (gets|will get|is going to get) hurt|make you (bleed|suffer|pay|scream|cry)|(will|shall|ll) bleed for"),
    (THREAT, 1.5, 0, "(one of these|some) (days|nights)|mark my words|next time i (see|meet|catch) you|when i (find|get|catch) you|(do|doing) (us|me|everyone|everybody|the world) a (favor|favour)|smug face|with my (own |bare )hands|sleep (well|lightly|tight)|look over your shoulder|before i am done|gun|knife"),
    (HATE, 3, 0, "(breed|breeding|multiply|multiplying|reproduce|swarm) like (rats|rabbits|animals|vermin|flies|cockroaches|dogs|insects|mice)"),
    (HATE, 3, 0, "(go|send them|send him|send her|send you|sent|get sent|ship them|shipped|crawl|went|get) back (to|) (where|wherever|your country|your own country|their country|their own country|africa|mexico|the jungle|the desert|your cave|their caves|their huts)"),
    (HATE, 3, 0, "gas (them|the jews|all of them)|gas chambers|heil hitler|white (power|trash|supremacy forever)|(wipe|wiped) (them |you |)off the (map|earth|face|planet)|final solution for|race traitor|race traitors|death to (all|the)"),
    (HATE, 3, 0, "subhuman|subhumans|untermenschen|untermensch|kike|kikes|nigger|niggers|nigga|spic|spics|wetback|wetbacks|chink|chinks|gook|gooks|faggot|faggots|fag|fags|dyke|dykes|tranny|trannies|shemale|towelhead|towelheads|raghead|ragheads|sandnigger|sandniggers|gypo|gypos|pikey|pikeys|paki|pakis|coon|coons|darkie|darkies|golliwog|beaner|beaners|camel jockey|camel jockeys|retarded|mongoloid|spastic|spastics"),
    (HATE, 2.5, 0, "(inferior|lesser|lower|mongrel|subhuman|weaker|degenerate|dirty|filthy|savage) (race|races|breed|people|peoples|blood|stock|tribe|minds|creatures|species|culture)"),
    (HATE, 2, 0, "({BEING}) ({LOW})|({MUST}) ({RID})|(belong|belongs) (in|behind|under|on) (|a |the )(kitchen|cage|cages|gutter|zoo|camp|camps|oven|ovens|jungle|ghetto|sewer|asylum|trees|bars|leash|street|stove|whip)"),
    (HATE, 2, 0, "(do not|don t|does not|never|hardly|nobody) (deserve|deserves) (|to )(live|breathe|exist|vote|work|rights|respect|a job|jobs|be here|be treated|be paid|be called|equal|better|the same)|less than human|not (really |fully |quite |even )(human|people)|born (liars|thieves|criminals|cheats|lazy|stupid|slaves)"),
    (HATE, 1.5, 0, "too (stupid|emotional|lazy|dumb|weak|primitive|dirty|hysterical|slow) (to|for)|(all|always|everywhere) (criminals|thieves|liars|rapists|terrorists|lazy|stupid|crooks|cheats)|(ruin|ruins|ruining|infest|infesting|infests|invade|invading|pollute|polluting|poison|poisoning|overrun|overrunning|stink|stinks|stinking|dirty|dirtying) (up |)(our|this|the|every) (country|company|town|city|place|neighborhood|neighbourhood|blood|race|nation|office|industry|business)|(spread|spreads|bring|brings) (disease|diseases|filth|crime|dirt)|(every last one|each and every one) of them|(keep|get|kick|throw|send) them (out|away)|no place (in|here|among)|decent (people|folk|folks)"),
    (HATE, 1.5, 3, "{GROUP}"),
    (SEXUAL, 3, 0, "slut|sluts|slutty|whore|whores|porn|porno|pornographic|tits|titties|titty|blowjob|blowjobs|handjob|handjobs|pussy|pussies|cumshot|cumshots|cumming|dildo|dildos|gangbang|gangbangs|threesome|orgasm|orgasms|masturbate|masturbates|masturbating|masturbation|horny|milf|milfs|fisting|deepthroat|creampie|jizz|xxx|hentai|upskirt|bukkake|cunnilingus|fellatio|rimjob|boner|hardon|camgirl|camgirls|escorts and sex"),
    (SEXUAL, 3, 0, "(suck|sucks|sucking|sucked|lick|licks|licking|licked|kiss|grab|grabs|grabbed|touch|touching|squeeze|squeezing|fondle|fondling|stroke|stroking|spank|spanking|rub|rubbing|play with|stare at|staring at) ({WHOSE}) (|big |tight |wet |sweet |hard |hot |soft |round |bare |little |huge )({BODY}|cocks|dicks)"),
    (SEXUAL, 3, 0, "({WHOSE}|a|big|hard|wet|tight) (big|tight|wet|sweet|hard|hot|soft|round|bare|naked|huge|nice|juicy|perky|firm|fat|throbbing) (tits|breasts|boobs|ass|arse|cock|dick|pussy|thighs|nipples|butt|body)"),
    (SEXUAL, 3, 0, "(fuck|fucks|fucked|fucking|screwed|banged|shag|shagged|rode|ride|rides|mount|mounted|pounded|undress|undresses|undressed|strip|strips) (me|her|him|you|us) (|all |so |hard |from |on |in |over |until |tonight |naked)"),
    (SEXUAL, 3, 0, "(fuck|fucks|fucked|suck|sucked|lick|licked|spank|undress|ravish|seduce) (her|him|me)|lick you|(off|down|in|into|under|up) (your|her|his|my) (panties|bra|underwear|skirt|pants|thong|blouse|dress|clothes)|(her|your|my|his) (panties|thong|bare breasts|bare ass|cock|dick|pussy|nipples|erection|bare thighs|ass|tits|boobs)"),
    (SEXUAL, 3, 0, "(hot|horny|naughty|sexy|naked|nude|wet|topless|kinky|dirty|lonely) (girl|girls|babe|babes|singles|teen|teens|moms|wives|housewives|chicks|sluts|pics|pictures|picture|photos|photo|video|videos|selfie|selfies|cams|cam|body|bodies|secretary|secretaries)"),
    (SEXUAL, 3, 0, "(sex|anal|oral) (with (me|you|her|him|us|hot|a stranger|strangers|your)|tape|tapes|cam|cams|chat|chats|toys|slave|slaves|sex|party|video|videos|in (my|your|the|his|her|every))|(have|had|having|want|wants|wild|hot|rough|hardcore|anal|oral|phone|group) sex"),
    (SEXUAL, 3, 0, "(make|made|makes|hear|heard|making) (you|her|him|me) (moan|moans|cum|scream in|orgasm|climax|wet|hard|beg for)|(wet|hot|hard|horny|willing|naked|ready) and (wet|willing|horny|hard|naked|ready|waiting for you)|(spread|open|opens|spreads|between|part) (your|her|his|my) (legs|thighs|knees)|(bend|bent|bends|bending) (you|her|me|him|over) (over|my|the|your|his|her)|(come|came) (to|up to) my (room|bed|place tonight)|sit on my (face|lap)|(see|saw|want|get|imagine|picture|have) (you|her|him|me) (naked|nude|topless|undressed)|(naked|nude) (on|in) (my|your|the|his|her|a) (bed|desk|lap|table|couch|sofa|office|shower|webcam|camera|front|copier|floor)|get naked|(strip|dance|undress) (for me|naked|on camera|on webcam|for you|for us)|(i am|i m|gets|got|get|makes me|made me|he gets|so) (so |)(horny|aroused|turned on|hard every|hard when|hard for|hard thinking|wet for|wet when|wet thinking)"),
    (SEXUAL, 1.5, 0, "naked|nude|topless|panties|thighs|moan|moans|moaning|undress|undressing|lust|lusty|lustful|cock|cocks|dick|dicks|breasts|boobs|sexy|erection|nipples|lingerie|seductive|erotic|kinky|thong|bedroom|bed|bare"),
    # other languages: insults and curses in general use, without accents
    (ABUSE, 3, 0, "dreckschwein|dreckschweine|drecksau|drecksack|drecksacke|arschloch|arschlocher|hurensohn|hurensohne|schlampe|schlampen|wichser|missgeburt|missgeburten|abschaum|fotze|fotzen|scheisskerl|scheisskerle|vollidiot|vollidioten|arschgeige|mistkerl|mistkerle|drecksvolk|verreckt|verrecke|verrecken sollt|krepiert|leck mich|leckt mich|verpiss dich|verpisst euch|halt die fresse|haltet die fresse|fick dich|fickt euch|(verdammte|verdammten|dreckige|dreckigen|blode|bloden|elende|elenden|miese|miesen|dumme|dummen|verfluchte|verfluchten|ihr) (idioten|schweine|sau|saue|penner|lugner|diebe|betruger|pack|gesindel|parasiten|ratten|verbrecher|gauner|affen)"),
    (ABUSE, 3, 0, "salaud|salauds|salope|salopes|connard|connards|connasse|connasses|encule|encules|enfoire|enfoires|batard|batards|ordures|raclure|raclures|pourriture|pourritures|fils de pute|fils de putes|ta gueule|vos gueules|va te faire|allez vous faire|va crever|allez crever|crevez|nique ta|niquez|va te faire foutre|(bande|tas|espece|especes|ramassis) (de|d) (cons|con|merde|merdes|voleurs|idiots|imbeciles|cretins|abrutis|porcs|rats|incapables|escrocs|menteurs|laches|debiles|clowns|ordures)|(sale|sales) (con|cons|porc|porcs|voleur|voleurs|menteur|menteurs|juif|arabe|arabes|noir|noirs|chien|chiens|pute|putes)"),
    (ABUSE, 3, 0, "cabron|cabrones|gilipollas|pendejo|pendejos|maricon|maricones|malnacido|malnacidos|hijo de puta|hijos de puta|hijos de la gran puta|hijueputa|hijueputas|de mierda|a la mierda|vete al infierno|vayanse al infierno|os voy a matar|los voy a matar|te voy a matar|(ojala) (se mueran|os murais|te mueras|revienten|se pudran)|muertos de hambre|chupame|(malditos|maldito|pinches|putos|puto|asquerosos|banda de|bola de|panda de|atajo de|partida de|pandilla de) (ladrones|ladron|idiotas|idiota|cerdos|cerdo|ratas|rata|imbeciles|mentirosos|estafadores|inutiles|parasitos|perros|bastardos)"),
    (ABUSE, 3, 0, "vaffanculo|stronzo|stronzi|stronza|coglione|coglioni|bastardi|puttana|puttane|troia|troie|cazzo|pezzo di merda|pezzi di merda|figlio di puttana|figli di puttana|andate all inferno|vai all inferno|crepa|crepate|dovete morire|vi ammazzo|ti ammazzo|va a morire|(maledetti|maledetto|branco di|razza di|banda di|manica di|sporchi|sporco|luridi|lurido|schifosi) (ladri|ladro|idioti|idiota|imbecilli|porci|porco|vermi|bugiardi|parassiti|truffatori|cani|schifosi|incapaci)|(ladri|porci|vermi) schifosi"),
    (ABUSE, 3, 0, "filho da puta|filhos da puta|vai se foder|vao se foder|vai tomar no|caralho|arrombado|arrombados|otarios|de merda|porra|klootzak|klootzakken|hoer|hoeren|kankerlijers|kankerlijer|eikels|kut|godverdomme|kurwa|kurwy|skurwysyn|skurwysyny|chuj|pierdol sie|jebany|javla|helvete|fan ta dig|orospu|siktir|сука|суки|пидор|пидоры|пидорас|мудак|мудаки|ублюдок|ублюдки|сволочь|сволочи|тварь|твари|блядь|бляди|хуй|пошел на"),
    (ABUSE, 2, 0, "idioten|schweine|scheisse|dreck|gesindel|pack|lumpenpack|crever|mierda|idiotas|ladrones|putas|merda|idioti|imbecilli|ladri|porci|cerdos|cochons|voleurs|imbeciles|abrutis|cretini|estupidos|ladroes"),
]

# Trade, science and report language in which a listed term means nothing of the kind.
EXCEPTIONS = [
    "(cock|stop cock|ball cock|petcock) (valve|valves)|(ball|stop|drain) cocks|(rat|rats|pest|vermin|rodent|parasite|snake|maggot|cockroach|leech) (control|proof|proofing|free|repellent|trap|traps|infestation|bite|bites)|guinea (pig|pigs)|(guinea|feeder|farm|feral|wild|breeding) (pig|pigs)|(pigs|hogs|swine|dogs|rats|worms|snakes|cattle|sheep|poultry|chickens|cats) (and|or) (pigs|hogs|swine|dogs|cats|rats|mice|cattle|sheep|poultry|chickens|goats|lizards|snakes)|swine (flu|fever|influenza|herd|production|feed|vaccine)|(hog|pig|swine) (farm|farms|farming|farmers|prices|iron)|pig iron|lab (rats|rat)|bed (and|bugs|linen|linens|sheets|capacity|frames|rest)|(hospital|flat|fluid|test|sick|twin|truck|river|sea|reactor|packed|seed) (bed|beds)|bedroom (home|homes|apartment|apartments|unit|units|house|houses|furniture)|(two|three|four|one|five) bedroom",
    "(naked|uncovered) (short|call|calls|put|puts|option|options|shorting|eye|position|positions|writing)|to the naked eye|sexy (growth|story|business|stock|name|product)|not (very |particularly |)sexy|nude (mice|mouse|shoes|lipstick|tones)|(chicken|duck|turkey|boneless) (breasts|breast|thighs|thigh)|breast (cancer|cancers|pump|pumps|milk|implants|reconstruction|biopsy)|erectile dysfunction|bare (bones|minimum|metal|root|die|board|boards|copper|steel|land)|pussy (willow|willows)|cat food",
    "(sexual|racial|verbal|physical) (harassment|abuse|misconduct|orientation|discrimination|assault)|(abusive|offensive|foul|vulgar) language|sexually transmitted|adult (entertainment|content|website|websites)|sex (discrimination|trafficking|offender|offenders|education|ratio)|hostile work environment|hate (speech|crime|crimes)|remarks of a sexual nature|(same|opposite) sex|child pornography|(anti|prohibits|prohibit|prohibiting|against) (pornographic|pornography)|pornographic (material|materials|content) (is|are) (prohibited|banned)",
    "(stupid|terrible|dumb|bad) (policy|idea|question|mistake|decision)|sick (leave|pay|days|day|time|building|employees)|(lazy|fat) (river|tail|tails|free)|low fat|corrupt (practices|data|files|practice|file)|(dirty|clean) (price|prices|bomb|tanker|tankers|coal|water)|bloody (mary|marys)|damn good|ugly (truth|duckling)",
    "(trash|garbage) (removal|collection|disposal|truck|trucks|can|cans|bags|bins|hauling|compactor|compactors|pickup|service|services|fees)|(identity|cyber|data|car|copper|cable|art|credit card) (thieves|thief|theft)|jerk (chicken|seasoning|sauce)|fool proof|foolproof|(prick|skin prick|finger prick) (test|tests|testing)|(craps|crap) (table|tables|game|games)|bastard (file|files|cut|sword)|(retards|retard) (corrosion|growth|fire|flame|flames|evaporation|rust|aging|the|spoilage)|fire retard|screw (fasteners|fastener|conveyor|press|machine|machines|thread|threads)|sucker rods|(earth|round|hook|heart|tape|ring) (worm|worms)|worm (gear|gears|drive)|(sniffer|guard|hot|guide|service|police) (dog|dogs)|dog food|(animal|intestinal|internal|external|malaria|fish|sea) (parasites|parasite|lice)|parasites (in|on|of|such)|(circus|rodeo) (clown|clowns)|clown fish|(dirt|gravel) (road|roads|bike|bikes|track|tracks)|dirt (and|removal|cheap|resistant)",
    "(kill|kills|killed|killing) (power|the|bacteria|weeds|germs|pests|cells|viruses)|beat (estimates|expectations|consensus|our|analyst|analysts|last|the (street|market|consensus|estimates|odds|competition|benchmark|index))|shoot (days|schedule|for)|hang (seng|up|gliding|tags|on)|burn (rate|rates|wounds|off|in|unit)|skin (care|cancer|test|graft|grafts|cream)|whip (lash|saw)|gun (safe|safes|shop|shops|store|stores|sales|owners|control|violence|laws|show|shows|manufacturer|manufacturers)|nail gun|(knife|knives) (blocks|block|sets|set|sharpener)",
    "women (and|in|on|s|who|with|are underrepresented|are still|of|over|aged|for)|(pregnant|older|young|younger|more|many|few|most) women|(hire|hires|hired|employ|employs|support|supports|supported|helps|help|helping|assist|protect|protects|welcome|welcomes) (women|refugees|immigrants|migrants|minorities|foreigners|pensioners|natives|indians|girls|disabled people|old people|homeless people|poor people)|native american|american indians|(refugees|immigrants|migrants|foreigners|minorities) (and|or|who|in|from|are supported|are welcome|with)|insulted because of|mocking (immigrants|women|foreigners|muslims|jews)",
]

LEAST = 3.0


def _closed(pattern: str) -> list[str]:
    """A pattern cut at the bars outside of brackets."""
    depth, start, parts = 0, 0, []
    for i, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            parts.append(pattern[start:i])
            start = i + 1
    return [*parts, pattern[start:]]


def expanded(pattern: str) -> list[str]:
    """The phrases that a pattern of ``(a|b)`` and ``{NAME}`` stands for."""
    for name, words in PARTS.items():
        if f"{{{name}}}" in pattern:
            pattern = pattern.replace(f"{{{name}}}", words if "|" in words else "|".join(words.split()))
    out: list[str] = []
    for part in _closed(pattern):
        choices, depth, start = [], 0, 0
        for i, ch in enumerate(part):
            if ch == "(":
                if not depth:
                    choices.append([part[start:i]])
                    start = i + 1
                depth += 1
            elif ch == ")":
                depth -= 1
                if not depth:
                    choices.append(expanded(part[start:i]))
                    start = i + 1
        choices.append([part[start:]])
        out += map("".join, product(*choices))
    return out


def _key(term: str) -> str:
    if not term.isascii():
        term = _MARKS.sub("", unicodedata.normalize("NFKD", term)).casefold().translate(_TABLE)
    return " ".join(term.replace("-", " ").split())


@lru_cache(maxsize=1)
def lexicon() -> dict[str, tuple[str, float, int]]:
    """Folded term -> (category, weight, what it counts once as); the strongest reading of a term holds."""
    out: dict[str, tuple[str, float, int]] = {}
    for category, weight, once, pattern in PATTERNS:
        for term in expanded(pattern):
            key = _key(term)
            if key and (key not in out or out[key][1] < weight):
                out[key] = (category, weight, once)
    return out


@lru_cache(maxsize=1)
def single_words() -> frozenset:
    return frozenset(w for term, (_, weight, _) in lexicon().items() if weight >= 1.5 for w in term.split())


@lru_cache(maxsize=1)
def masked_words() -> dict[tuple[str, int, str], str]:
    """(first letter, length, last letter) -> the word that asterisks hide, of the strong lone words."""
    strong = "fuck fucking fucked fucker fuckers shit bullshit asshole assholes bastard bastards bitch bitches cunt cunts cock cocks dick dicks tits porn slut sluts whore whores pussy scum motherfucker motherfuckers nigger niggers faggot faggots panties nude naked".split()
    return {(w[0], len(w), w[-1]): w for w in reversed(strong)}


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick automaton over the folded lexicon and the exception phrases."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, (category, weight, group) in lexicon().items():
        once = re.sub(r"([a-z])\1", r"\1", term)
        for variant in {term, once} if " " not in term and len(once) >= 5 and weight >= 3 else {term}:
            a.add_word(f" {variant} ", (category, weight, group, len(variant) + 2, term))
    for term in (t for pattern in EXCEPTIONS for t in expanded(pattern)):
        a.add_word(f" {_key(term)} ", ("", 0.0, 0, len(_key(term)) + 2, term))
    a.make_automaton()
    return a


def passages(text: str) -> tuple[list[tuple[float, str]], int]:
    """``(weight, category)`` of each passage with a listed term, and the number of words.

    Hits within an exception phrase are dropped. Of hits that overlap the
    heaviest counts; a term repeated within the passage counts once.
    """
    folded = fold(text)
    by: dict[int, list[tuple[int, int, str, float, int, str]]] = {}
    safe: list[tuple[int, int]] = []
    for end, (category, weight, once, size, term) in automaton().iter(folded):
        at = (end - size + 1, end)
        if weight:
            by.setdefault(folded.count("\n", 0, end) if "\n" in folded else 0, []).append((*at, category, weight, once, term))
        else:
            safe.append(at)
    out = []
    for hits in by.values():
        taken: list[tuple[int, int]] = []
        seen: set = set()
        total: dict[str, float] = {}
        offence = False
        for a, b, category, weight, once, term in sorted(hits, key=lambda h: (-h[3], h[0])):
            if any(a < y and x < b for x, y in taken) or any(x <= a + 1 and b - 1 <= y or a < y and x < b for x, y in safe):
                continue
            if (once or term) in seen:
                continue
            seen.add(once or term)
            taken.append((a + 1, b - 1))
            total[category] = total.get(category, 0.0) + weight
            offence |= weight >= 1.5 and not once
        # adjectives, an address or a group named are no offence by themselves, nor together
        if offence:
            out.append((sum(total.values()), max(total, key=lambda c: (total[c], c))))
    return out, folded.count(" ") - 1


def score(text: str | None) -> tuple[float, float, int, str | None]:
    """``(score per 100 words, weight of the worst passage, passages that count, category)``."""
    if not text:
        return 0.0, 0.0, 0, None
    found, n = passages(text)
    bad = [(w, c) for w, c in found if w >= LEAST]
    if "      " in text and _GAP.search(text):  # a long gap may part two words, or one word in two
        other, _ = passages(_GAP.sub("", text))
        if sum(w >= LEAST for w, _ in other) > len(bad):
            found, bad = other, [(w, c) for w, c in other if w >= LEAST]
    per = round(100.0 * sum(w for w, _ in bad) / max(n, 1), 4)
    worst = max((w for w, _ in found), default=0.0)
    by: dict[str, float] = {}
    for w, c in bad:
        by[c] = by.get(c, 0.0) + w
    return per, round(worst, 4), len(bad), max(by, key=lambda c: (by[c], c)) if by else None


_OUT = T.StructType(
    [
        T.StructField("toxicity", T.DoubleType()),
        T.StructField("worst_passage", T.DoubleType()),
        T.StructField("n_passages", T.IntegerType()),
        T.StructField("category", T.StringType()),
    ]
)


def score_texts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys``, ``toxicity`` (weight of bad passages per 100 words), ``worst_passage``, ``n_passages`` and ``category``.

    A passage is bad from a weight of 3 on; a document is to be reviewed if it
    has at least one. Null and empty texts score 0 without a category. Rows are
    scored where they lie, whole texts, without a shuffle; repeated rows are
    scored each. Key columns named like the results are an error.
    """
    if clash := set(_OUT.names) & set(keys):
        raise ValueError(f"key columns {sorted(clash)} have names of the result")
    schema = T.StructType([*(df.schema[k] for k in keys), *_OUT.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [score(t if isinstance(t, str) else None) for t in batch["_text"]]
            yield pd.concat([batch[keys], pd.DataFrame(found, columns=_OUT.names, index=batch.index)], axis=1)

    return df.select(*keys, F.col(text).alias("_text")).mapInPandas(run, schema)


def rates(scored: DataFrame, by: str) -> DataFrame:
    """Per value of ``by`` (null is one): documents, those with bad passages, their share, and the mean score."""
    return scored.groupBy(by).agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("n_passages") > 0).alias("n_flagged"),
        F.round(F.count_if(F.col("n_passages") > 0) / F.count("*"), 6).alias("flagged_share"),
        F.round(F.avg("toxicity"), 6).alias("mean_toxicity"),
        *(F.count_if(F.col("category") == c).alias(f"n_{c}") for c in (ABUSE, THREAT, HATE, SEXUAL)),
    )
