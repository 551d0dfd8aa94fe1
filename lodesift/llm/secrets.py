"""Credentials embedded in source code: literals that words leave unexplained, found near assignments, masked in place.

A literal is a quoted text, the value of a configuration line, or a part of an address, a header or a
command line. It is segmented into dictionary words by Viterbi, and scored by what that leaves to be
explained: the nats of the characters no word covers and of the words themselves, less what words of
stand-ins (``your``, ``here``) take off; words of its own name explain themselves. What stands before the
literal sets how much is needed: little under the name of a secret, more among the arguments of a login
or behind a scheme word, and in any other assignment a long residual that words don't explain. Literals
of known other forms (look-ups, variables, hashes, ids, certificates) are out whatever their score.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that name a secret, words that make a key one, words after them that change nothing.
NOUNS = "password passwd passwords pwd pass passphrase passcode passwort pw secret token apikey credential credentials cred creds auth authtoken jwt pat psk secretkey accesskey authkey privatekey dsnpassword userpass".split()
KEY_OF = "api access auth private signing sign signature master encryption encrypt decryption client secret session shared account webhook storage service app application admin hmac aes root license deploy ssh rsa server cipher wrapping jwt subscription".split()
# Words that make a key one of a table, a cache or a message, or a public one.
OTHER_KEY_OF = "public publishable site cache sort foreign partition primary unique composite natural surrogate shard routing row object hash range index group lookup idempotency dedupe dedup".split()
QUALIFIERS = "default value val literal string str text plain prod production dev test staging old new current b64 base64 enc encoded raw env var primary secondary here 1 2 3 main backup".split()
# Heads that make a name something else than a secret.
OTHER_HEADS = "id ids uid uuid guid file path dir name names url uri link endpoint header headers field fields ttl expiry expires length len min max count rate type kind hint rules rule ref label format alg algorithm regex pattern policy timeout hash hashes salt iv nonce prefix suffix index size user username host port scope scopes issuer audience provider method mode version rev revision commit sha sha1 sha256 sha512 md5 digest checksum etag integrity fingerprint thumbprint trace request build correlation span certificate cert crt public image seed signature sum crc page cursor color colour class css style placeholder title message".split()
# Words of texts that stand for a value.
STANDING = "your here insert replace change changeme paste example redacted hidden removed placeholder enter todo none null nil undefined dummy sample fake masked omitted secretvalue goes fixme tbd must choose provide confirm required invalid wrong missing forgot please empty unset default true false".split()

# What a literal has to leave unexplained, in nats, by where it stands.
NAMED, LOGIN, HEADER, NEUTRAL = 13.0, 20.0, 30.0, 45.0
LETTER, DIGIT, MARK, JOIN = 3.6, 2.3, 2.5, 0.7  # nats of a character that no word covers; JOIN between words
TAKEN_OFF = 7.0  # by a word of stand-ins
KNOWN = 1.0  # nats of a word that a secret's name leads to expect
RUNS = re.compile(r"(.)\1{3,}|[A-Za-z]+|\d+|.", re.S)


@lru_cache(4)
def dictionary(path: str) -> dict[str, float]:
    """Costs of words: of a public word-piece vocabulary, where a word's place gives its frequency.

    ``path`` is that of a tokenizer file whose whole words end with ``</w>``; empty for the words of
    this module alone.
    """
    costs = {}
    if path:
        import json

        with open(path, encoding="utf-8") as f:
            ranks = json.load(f)["model"]["vocab"]
        for piece, rank in ranks.items():
            if piece.endswith("</w>") and len(piece) > 6 and piece[:-4].isalpha():
                costs[piece[:-4]] = 4 + math.log(rank + 1)
    for words, cost in ((STANDING, 7.0), (OTHER_HEADS, 8.0), (KEY_OF, 7.5), (NOUNS, 7.0), (["key", "app", "admin", "database", "db", "smtp", "kv", "s3", "basic", "login", "client", "server", "user"], 9.0)):
        for w in words:
            if len(w) > 1:
                costs[w] = min(cost, costs.get(w, cost))
    return costs


def words_path() -> str:
    """The word-piece vocabulary of the public tokenizers, if they are installed."""
    try:
        import public_tokenizers
    except ImportError:
        return ""
    return public_tokenizers.path("word_bpe_49k.json")


STAND = frozenset(STANDING)
UNKNOWN = 11.0  # cost of a character that no word covers
LONGEST = 20


@lru_cache(4)
def automaton(path: str) -> ahocorasick.Automaton:
    """Finds every dictionary word in a text."""
    found = ahocorasick.Automaton()
    for word, cost in dictionary(path).items():
        if 1 < len(word) <= LONGEST:
            found.add_word(word, (len(word), cost))
    found.make_automaton()
    return found


def segment(text: str, found: ahocorasick.Automaton) -> tuple[list[str], int]:
    """The cheapest segmentation of a run of lower-case letters: its words, and the number of letters left over."""
    n = len(text)
    best, back, done = [0.0] * (n + 1), [0] * (n + 1), 0

    def upto(end: int) -> int:
        for k in range(done + 1, end + 1):
            if not back[k]:
                best[k], back[k] = best[k - 1] + UNKNOWN, -1
            elif best[k - 1] + UNKNOWN <= best[k]:
                best[k], back[k] = best[k - 1] + UNKNOWN, -1
        return end

    for last, (size, cost) in found.iter(text):
        done = upto(last)
        at = last + 1
        whole = best[at - size] + cost
        if not back[at] or whole < best[at]:
            best[at], back[at] = whole, size
    upto(n)
    words, left, end = [], 0, n
    while end:
        if back[end] > 0:
            words.append(text[end - back[end] : end])
            end -= back[end]
        else:
            left, end = left + 1, end - 1
    return words[::-1], left


PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Words:
    """Segments names and literals; keeps what it has segmented, up to a bound, then starts anew."""

    def __init__(self, path: str) -> None:
        self.costs, self.found, self.known = dictionary(path), automaton(path), {}

    def of(self, text: str) -> tuple[list[str], int]:
        """Words of a text, cut at capitals and by Viterbi, and the number of characters they don't explain."""
        got = self.known.get(text)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            words, left = [], 0
            for run in re.findall(r"[A-Za-z]+|\d+", text):
                if run.isdigit():
                    words, left = [*words, run], left + (len(run) if len(run) > 4 else 0)
                    continue
                whole, over = segment(run.lower(), self.found)
                cut, cut_over = [], 0
                for part in PARTS.findall(run):
                    w, o = segment(part.lower(), self.found)
                    cut, cut_over = cut + w, cut_over + o
                if cut_over <= over:
                    whole, over = cut, cut_over
                words, left = words + whole, left + over
            got = self.known[text] = words, left
        return got

    def score(self, value: str, name: str) -> float:
        """Nats that a value leaves unexplained under a name."""
        expected = {*NOUNS, "key", "api", *(w for w in self.of(name)[0] if len(w) > 1), "".join(re.findall("[a-z]+", name.lower()))}
        total = 0.0
        for m in RUNS.finditer(value):
            run = m[0]
            if m[1]:
                total += LETTER  # a character over and over
            elif run.isdigit():
                total += DIGIT * len(run)
            elif not (run.isascii() and run.isalpha()):
                total += JOIN if run in "-_. /:" else MARK
            elif run.lower() in expected:
                total += KNOWN
            else:
                words, left = self.of(run)
                total += LETTER * left
                for w in words:
                    whole = len(w) > 3 or w == run.lower()
                    total += KNOWN if w in expected and whole else -TAKEN_OFF if w in STAND and whole else min(self.costs[w], LETTER * len(w))
        return total

    def unexplained(self, text: str) -> int:
        """Characters outside words of four letters or more that keep to the text's capitals."""
        left = 0
        for part in PARTS.findall(text):
            left += len(part) if part.isdigit() else len(part) - sum(len(w) for w in segment(part.lower(), self.found)[0] if len(w) > 3)
        return left


class Found(NamedTuple):
    start: int
    end: int
    kind: str
    more: tuple[tuple[int, int], ...] = ()  # further pieces


NAME = r"[A-Za-z_$@#.:][\w$.\-/]*"
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
QUOTED = re.compile(r"""(?P<q>"|'|`)(?P<v>(?:\\.|(?!(?P=q))[^\\\r\n])*)(?P=q)""")
WRAP = r"""(?:(?:String::from|Some|str|bytes|SecretStr|Secret|new\s+\w+|to_string|Buffer\.from|quote|unhex|b64decode|base64\.b64decode|atob)\s*\(\s*|[brfuBRFU]{1,2}(?=$)|&|@(?=$)|\(\s*)*"""
# What stands right before an opening quote, and gives the name of the literal.


def behind(pattern: str) -> regex.Pattern:
    """A pattern that ends at the literal, matched backwards from there."""
    return regex.compile(pattern, regex.REVERSE)


# What stands right before an opening quote, and gives the name of the literal.
OPTION = behind(r"""["'`]--?(?P<n>[\w\-]+)["'`]\s*,(?:[^"'`]*,)?\s*default\s*=\s*$""")
_BEFORE = [
    behind(rf"""(?P<n>{NAME})["'`\]\)]*\s*(?:\?\s*)?(?::\s*[&\w<>\[\]'?.]+\s*)?(?:=>|:=|\?\?=|\|\|=|=|:)\s*{WRAP}$"""),
    behind(rf"""["'`](?P<n>{NAME})["'`]\s*,\s*{WRAP}$"""),
    behind(rf"""\b(?:with|set|put|add|use)_?(?P<n>\w+)\(\s*{WRAP}$"""),
    behind(rf"""(?P<n>{NAME})["'`\]\)]*\s*(?:\|\||\?\?|\bor\b|\?:|:-)\s*{WRAP}$"""),
    behind(r"""\b(?:key|name|id)=["'](?P<n>[^"']+)["']\s+(?:\w+=["'][^"']*["']\s+)*value=$"""),
    behind(r"""(?P<n>PASSWORD|IDENTIFIED\s+BY|SECRET|identified\s+by|password)\s+$"""),
    behind(rf"""--?(?P<n>[A-Za-z][\w\-]*)[ =]$"""),
]
# Each with the characters that may be the last before the literal; those that WRAP ends with go with the first.
ANY = "".join(map(chr, range(33, 127)))
BEFORE = list(zip([OPTION, *_BEFORE], ["=", ANY.translate({ord(x): None for x in ",;)]}"}), ANY, "(", ANY, "=", ANY, "=" + ANY]))
FROM_LITERAL = re.compile(r"""--from-literal[= ]["']?(?P<n>[\w.\-]+)=(?P<v>[^\s"'`]+)""")
LOGIN_CALL = behind(r"""(?:getConnection|basic_auth|basicAuth|login|authenticate|connect|auth|credentials|Credentials|HTTPBasicAuth|setCredentials|createConnection|PDO|mysqli|mysqli_connect|mysql_connect|pg_connect)\s*[(= ]\(?\s*[^();{}\r\n]*,\s*$""")
FILL = behind(r"""(?:fill|type|sendKeys|send_keys|fill_in|setValue)\s*\(?\s*["'](?P<n>[^"']*)["']\s*,\s*(?:with:\s*)?$""")
# Values without quotes.
LINE = re.compile(rf"""(?m)^[ \t]*(?:[#;*>]+[ \t]*|//[ \t]*|--[ \t]+|<!--[ \t]*|-[ \t]+|export[ \t]+|ENV[ \t]+|ARG[ \t]+|set[ \t]+|setx[ \t]+|declare[ \t]+-x[ \t]+)*(?P<n>[A-Za-z_$][\w$.\-]*)[ \t]*(?P<o>:=|=|:)[ \t]*(?P<v>[^\s"'`#,;{{][^\s]*)""")
FLOW = re.compile(r"""[{,]\s*(?P<n>[A-Za-z_][\w\-.]*)\s*:\s*(?P<v>[^\s"'`,{}\[\]]+)\s*(?=[,}])""")
FLAG = re.compile(r"""(?<![\w-])--?(?P<n>[A-Za-z][\w\-]+)(?:[ \t]+|=)(?P<v>[^\s"'`\\-][^\s"'`\\]*)""")
USER_FLAG = re.compile(r"""(?<![\w-])(?:-u|--user)[ \t=]+["']?[\w.\-]+:(?P<v>[^\s"'`]+)""")
URL_USER = re.compile(r"""[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@"'`<>]*:(?P<v>[^\s/"'`]+)@""")
QUERY = re.compile(r"""[?&;](?:amp;)?(?P<n>[A-Za-z_][\w.\- ]*)=(?P<v>[^&;\s"'`]+)""")
PAIR_START = re.compile(r"""["'`](?P<n>[A-Za-z_][\w]*)=(?P<v>[^&;\s"'`]+)[;&]""")
SCHEME = re.compile(r"""\b(?P<s>Bearer|Basic|Token|ApiKey|bearer|basic|token)[ \t]+(?P<v>[A-Za-z0-9][\w.~+/=\-]{7,})""")
PROSE = re.compile(r"""(?i)\b(?P<n>password|passphrase|passwd|pwd|pw|passcode|secret|token|api[ _-]?key|credential)s?\b[^\S\r\n]*(?:is|was|=|:|->|now|still)+[^\S\r\n]*(?:now|still)?[^\S\r\n]*(?P<v>[^\s"'`,]+)""")
GLUED_FLAG = re.compile(r"""\b(?:mysql|mysqldump|mysqladmin|mariadb|sshpass|redis-cli|7z|zip|unzip)\b[^\r\n|;]*?\s-[paP][ ]?(?P<q>["']?)(?P<v>[^\s"'`]{4,})(?P=q)""")
DSN = re.compile(r"""["'`][\w.\-]+:(?P<v>[^\s"'`/]+)@(?:tcp|unix|udp)\(""")
PIPED = re.compile(r"""\b(?:echo|printf)\s+(?:-n\s+)?["']?(?P<v>[^\s"'`|]+)["']?\s*\|[^\r\n]*--(?:password|token|pass|secret)-stdin""")
SLASH_LOGIN = re.compile(r"""(?i)\blogin\b[^\r\n:]*:\s*[\w.\-]+\s*/\s*(?P<v>\S+)""")
NETRC = re.compile(r"""\blogin\s+\S+\s+password\s+(?P<v>\S+)""")
AUTH_TOKEN = re.compile(r""":_(?:authToken|password|auth)=(?P<v>[^\s"'`]+)""")
ELEMENT = re.compile(r"""<(?P<n>[A-Za-z_][\w.\-]*)(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[)?(?P<v>[^<>\r\n]+?)(?:\]\]>)?\s*</(?P=n)>""")
FALLBACK = re.compile(r"""\$\{(?P<n>\w+):?-(?P<v>[^}\s"'`]+)\}""")

JOINED = re.compile(r"\s*(?:\+|\.\.?|&|<>|\\)\s*\\?\s*")
NEXT_LINE, ALONE = re.compile(r"[ \t]*\r?\n[ \t]+"), re.compile(r"[ \t]*[;)]*[ \t]*(?:\r?\n|\Z)|[ \t]*\+")
MEMBER_NAME = re.compile(r"[ \t]*\]?[ \t]*(?::(?!=)|=>|[ \t]=[ \t])[ \t]*\S")
AUTHORIZES = re.compile(r"(?i)auth|header|curl|bearer")
MEASURE = re.compile(r"\d{1,5}|\d+(?:\.\d+)?(?:ms|s|m|h|d|k|kb|mb)|\d+\.\d+|[a-z]+(?:[._][a-z]+)*\.[a-z]+(?:[._][a-z]+)*")
JWT = re.compile(r"eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]*")
HEX = re.compile(r"(?i)(?:0x)?[0-9a-f]+")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
HASHED = re.compile(r"(?i)(?:sha\d*|md5|blake\w*|crc\w*)[-:].*|\$(?:2[abxy]|argon2\w*|1|5|6|pbkdf2[\w-]*|scrypt)\$.*|\{(?:SSHA|SHA|MD5|CRYPT)\d*\}.*|W/.*|pbkdf2_\w+\$.*")
PUBLIC = re.compile(r"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2)|data:[\w/+.\-]+;base64,|AAAA[BCE]3Nza|-----BEGIN|MII[A-Z]")
STANDS = re.compile(r"""(?x) \$ [\s({A-Za-z_] .* | \$?\{ .* | \{\{ .* | %.+%  | %\(.* | %s | %v | %d | \#\{ .* | @@? .* @@? | @\w+ | < .* | \[ .* | _{2,} .* | [.*•x_X0?#=-]{3,} | (.)\1{3,} | :'?\w+'? | \? | \(.*\) | &\w+ | \*+ | !\w.* | %%.* """)
LOOKUP = re.compile(r"""(?x) (?:vault|ssm|op|arn|env|file|secretsmanager|secretmanager|awskms|kms|gcp|gcpsm|keyring|keychain|kv|ref|azurekeyvault|akv|sops|doppler|bws|pass|credstash|cmd|exec|k8s|consul|chamber|config|conf|settings|secret|secrets):\S* | /[\w./\-]+ | \.{1,2}/\S* | ~/\S* | [A-Za-z]:\\\S* | [a-z][a-z0-9+.\-]*://\S* | [\w./\-]+\.(?:pem|key|crt|p12|pfx|json|ya?ml|txt|jks|env|conf) | (?:process\.env|os\.environ|os\.getenv|getenv|System\.getenv|ENV|env|config|settings|secrets|vault|var|local|data|module|each|self|this|ctx|props|params|args|request|req)[.(\[].* | \w+\(.*  | [A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*\([^)]*\)?;? """)

CONFIG = re.compile(r"(?:^|/)(?:\.?env(?:\.[\w.]+)?|[\w.\-]+\.env(?:\.\w+)?|Dockerfile[\w.\-]*|\.netrc|\.npmrc|\.pypirc|[\w.\-]*\.(?:ini|properties|ya?ml|sh|bash|zsh|conf|cfg|cnf|toml|tfvars|env|txt|bat|ps1))$", re.I)


def _back(text: str, end: int, blanks: str = "\r\n \t\\") -> int:
    """The end of what stands before ``end``, without blanks; line ends and line-joining slashes count too."""
    while end and text[end - 1] in blanks:
        end -= 1
    return end


BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
# What a text must have for a pattern to match in it, as a pattern of its own that a whole batch is tested by.
SIGNS = {
    PEM: "-----BEGIN ", BLOCK: "-----BEGIN ", URL_USER: "://[^\\s]*@", SCHEME: "(Bearer|Basic|Token|ApiKey|bearer|basic|token)[ \\t]", QUERY: "[?&;][^=]*=", PAIR_START: "=[^&;]*[;&]", AUTH_TOKEN: ":_", NETRC: "login\\s",
    SLASH_LOGIN: "(?i)login[^\\r\\n]*/", USER_FLAG: "(-u|--user)[ \\t=]", GLUED_FLAG: "\\s-[paP]", DSN: "@(tcp|unix|udp)", PIPED: "-stdin", ELEMENT: "</", FALLBACK: "-[^}]*}", LINE: "(?m)^[ \\t]*([#;*>-]|//|<!--|export |ENV |ARG |set)", FROM_LITERAL: "--from-literal",
    FLOW: "[{,][^,}]*:", FLAG: "-[A-Za-z]", PROSE: "(?i)(#|;|\\*|//|--|\"\"\").*(pass|pwd?|secret|token|api|credential)",
}
BIT = {rx: 1 << k for k, rx in enumerate(SIGNS)}
QUOTES = 1 << len(SIGNS)


def signs_in(texts: pa.Array) -> np.ndarray:
    """The signs in each text of a batch, as bits; in time linear in the texts."""
    out = np.zeros(len(texts), np.int64)
    for sign, bit in [*((sign, BIT[rx]) for rx, sign in SIGNS.items()), ("[\"'`]", QUOTES)]:
        out |= np.where(np.asarray(pc.fill_null(pc.match_substring_regex(texts, sign), False)), bit, 0)
    return out


COMMENT = re.compile(r"\s*(?:[#;*]|//|--\s|<!--)")
REMARK = re.compile(r"\s*(?:[#;*]|//|--|<!--|/\*|\"\"\")")
BEHIND_VALUE = re.compile(r"-->|\*/|</")
LEADING_SCHEME = re.compile(r"(?:Bearer|Basic|Token|ApiKey|bearer|basic)\s+")
SQL_VARIABLE = behind(r"(?i)(?:password|by)\s+:$")
KEY_ATTRIBUTE = behind(r"""\b(?:key|name|id)=["']([^"']+)["'][^;{}\r\n]*$""")


class Finder:
    """Finds credentials in an excerpt of a file."""

    def __init__(self, path: str | None = None) -> None:
        self.words = Words(words_path() if path is None else path)

    def strength(self, name: str, query: bool = False) -> int:
        """2 if a name means a secret, 1 if nothing is known against it, 0 if it means something else."""
        words = [w for w in self.words.of(name)[0]]
        while len(words) > 1 and (words[-1] in QUALIFIERS or len(words[-1]) == 1) and any(w in NOUNS or w == "key" for w in words[:-1]):
            words.pop()
        if not words:
            return 1
        head, before = words[-1], words[-2] if len(words) > 1 else ""
        if head in NOUNS:
            return 0 if before in ("min", "max", "csrf", "xsrf", "page", "next", "public", "no", "has", "is") else 2
        if head == "key" or head == "keys":
            if before in KEY_OF or (query and not before):
                return 2
            parts = [p.lower() for p in PARTS.findall(name)]
            return 0 if before in OTHER_KEY_OF or any(a in OTHER_KEY_OF and b in ("key", "keys") for a, b in zip(parts, parts[1:])) else 1
        if head in OTHER_HEADS or (before == "public"):
            return 0
        return 1

    def literal(self, value: str, name: str, least: float = NAMED) -> bool:
        """Whether a value is of no other form and leaves at least so much unexplained."""
        v = value.strip()
        if STANDS.fullmatch(v) or MEASURE.fullmatch(v) or PUBLIC.match(v) or HASHED.fullmatch(v) or self._lookup(v):
            return False
        if " " in v and self.words.of(v)[1] < 0.5 * len(v):
            return False  # prose
        return self.words.score(v, name) >= least

    def _lookup(self, v: str) -> bool:
        """Whether a value only says where to find one; base64 text may look like a path."""
        if not LOOKUP.fullmatch(v):
            return False
        return not (v[:1] == "/" and len(v) >= 16 and re.search(r"\d", v) and re.search("[A-Z]", v) and self.words.unexplained(v) >= 0.5 * len(v))

    def residual(self, value: str) -> bool:
        """Whether a literal is a long text that words don't explain, of no known other form."""
        if JWT.fullmatch(value):
            return True
        if len(value) < 16 or re.search(r"[\s<>{}()\[\]$%,;:|\\*\"']", value) or UUID.fullmatch(value) or HEX.fullmatch(value) or HASHED.fullmatch(value) or PUBLIC.match(value) or LOOKUP.fullmatch(value) or "/" in value[:2]:
            return False
        if value.count("/") > 1 and not value.endswith("=") and self.words.of(value)[1] < 0.5 * len(value):
            return False
        longest = max(re.findall(r"[A-Za-z0-9+/]+", value) or [""], key=len)
        if len(longest) < 12 or not all(re.search(k, longest) for k in ("[a-z]", "[A-Z]", r"\d")):
            return False
        return self.words.unexplained(longest) >= max(8, 0.5 * len(longest)) and self.words.score(value, "") >= NEUTRAL

    def _judge(self, name: str, value: str, query: bool = False) -> str | None:
        strength = self.strength(name, query)
        if strength == 2:
            return "named" if self.literal(value, name) else None
        return "residual" if strength == 1 and self.residual(value) else None

    def find(self, text: str, path: str = "", signs: int | None = None) -> list[Found]:
        """Credentials of an excerpt by start, none inside another; ``signs`` are those of the text, if known."""
        signs = int(signs_in(pa.array([text]))[0]) if signs is None else signs
        out: list[Found] = []
        taken = bytearray(len(text))  # 1 where something is known
        config = bool(CONFIG.search(path or ""))
        if not signs and not config:
            return out

        def each(rx: re.Pattern) -> Iterable[re.Match]:
            """Matches of a pattern, which isn't tried on a text without its sign."""
            return rx.finditer(text) if signs & BIT[rx] else ()

        def free(a: int, b: int) -> bool:
            return taken.find(1, a, b) < 0

        def take(a: int, b: int) -> None:
            taken[a:b] = b"\1" * (b - a)

        def give(a: int, b: int, kind: str, more: tuple = ()) -> None:
            if a < b and free(a, b):
                out.append(Found(a, b, kind, more))
                for x, y in ((a, b), *more):
                    take(x, y)

        for m in each(PEM):
            end = PEM_END.search(text, m.end())
            stop = end.end() if end else len(text)
            body = text[m.end() : end.start() if end else len(text)]
            if free(m.start(), stop):
                if re.search(r"[A-Za-z0-9+/=]{16}", body):
                    give(m.start(), stop, "private key")
                else:
                    take(m.start(), stop)
        for m in each(BLOCK):
            if free(m.start(), m.end()):
                end = text.find("-----END", m.end())
                stop = text.find("\n", end) if end >= 0 else -1
                take(m.start(), stop if stop > 0 else len(text))
        for m in each(URL_USER):
            if self.literal(m["v"], "password"):
                give(*m.span("v"), "address")
            else:
                take(*m.span("v"))
        for m in each(SCHEME):
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            if m["s"].lower() != "bearer" and not AUTHORIZES.search(line):
                continue
            v = m["v"].rstrip(".")
            if free(*m.span("v")) and self._behind_scheme(m["s"], v):
                give(m.start("v"), m.start("v") + len(v), "header")
        for rx in (QUERY, PAIR_START):
            for m in each(rx):
                if self.strength(m["n"].strip(), True) == 2 and free(*m.span("v")):
                    v = m["v"]
                    if self.literal(v, m["n"]):
                        give(*m.span("v"), "address")
                    else:
                        take(*m.span("v"))
        for rx in (AUTH_TOKEN, NETRC, SLASH_LOGIN, USER_FLAG, GLUED_FLAG, DSN, PIPED):
            for m in each(rx):
                v = m["v"].rstrip("\"'`,;)")
                if self.literal(v, "token"):
                    give(m.start("v"), m.start("v") + len(v), "login")
        if signs & QUOTES:
            self._quoted(text, give, free)
        for m in each(ELEMENT):
            v = m["v"].strip()
            if v and self._judge(m["n"], v):
                at = m.start("v") + m["v"].index(v)
                give(at, at + len(v), "element")
        for m in each(FALLBACK):
            if self.strength(m["n"]) == 2 and self.literal(m["v"], m["n"]):
                give(*m.span("v"), "fallback")
        for m in LINE.finditer(text) if config else each(LINE):
            if config or COMMENT.match(m[0]):
                self._bare(m, give, text)
        for rx in (FROM_LITERAL, FLOW, FLAG):
            for m in each(rx):
                self._bare(m, give, text)
        for m in each(PROSE):
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            if REMARK.match(line) or (config and "#" in line):
                v = m["v"].rstrip(".,;)")
                if self.literal(v, m["n"]) and len(v) >= 6:
                    give(m.start("v"), m.start("v") + len(v), "comment")
        return sorted(out)

    def _behind_scheme(self, scheme: str, v: str) -> bool:
        """Whether what stands behind a scheme word is a token, or, behind ``Basic``, an encoded login."""
        if scheme.lower() == "basic":
            try:
                return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
            except (binascii.Error, ValueError):
                return False
        return self.literal(v, "token", HEADER) and v.lower() != v.upper()

    def _bare(self, m: re.Match, give, text: str) -> None:  # noqa: ANN001
        v = BEHIND_VALUE.split(m["v"])[0].rstrip(",;")
        if not v or v[0] in "|>&*!" or v in ("Bearer", "Basic", "Token"):
            return
        if self._judge(m["n"], v):
            give(m.start("v"), m.start("v") + len(v), "value")

    def _quoted(self, text: str, give, free) -> None:  # noqa: ANN001
        marks = list(QUOTED.finditer(text))
        k = 0
        while k < len(marks):
            m = marks[k]
            a, b = m.span("v")
            pieces = [(a, b)]
            # Pieces joined by an operator, or simply set one behind the other over lines.
            while k + 1 < len(marks) and self._joined(text, marks[k].end(), marks[k + 1]):
                k += 1
                pieces.append(marks[k].span("v"))
            k += 1
            if a == b or not free(a, b) or MEMBER_NAME.match(text, marks[k - 1].end()):
                continue  # nothing, known already, or a member's name
            # The literal's context ends with its line, or goes on above if only blanks stand before it.
            value, end = "".join(text[x:y] for x, y in pieces), m.start()
            last = _back(text, end, " \t")
            if not last or text[last - 1] in "\r\n":
                end = _back(text, last)
                if not text[max(0, end - 2) : end].endswith(("=", "(", ":", "+", "||")):
                    continue
            self._one(text, text.rfind("\n", 0, end) + 1, end, value, pieces, give)

    def _joined(self, text: str, end: int, following: re.Match) -> bool:
        """Whether a quoted text goes on with the next: by an operator, or alone on the next line."""
        between = text[end : following.start()]
        if JOINED.fullmatch(between):
            return True
        return bool(NEXT_LINE.fullmatch(between) and ALONE.match(text, following.end()))

    def _one(self, text: str, start: int, end: int, value: str, pieces: list[tuple[int, int]], give) -> None:  # noqa: ANN001
        a, b = pieces[0]
        head = LEADING_SCHEME.match(value)
        if head and len(pieces) == 1:
            value, a = value[head.end() :], a + head.end()
        rest = tuple(pieces[1:])
        last = text[(at := _back(text, end, " \t")) - 1 : at]
        fill = last in ",:" and FILL.match(text, start, end)
        if fill:
            if self.strength(fill["n"]) == 2 and self.literal(value, fill["n"]):
                give(a, b, "form", rest)
            return
        if last == ":" and SQL_VARIABLE.match(text, start, end):
            return
        for rx, signs in BEFORE:
            m = last in signs and rx.match(text, start, end)
            if not m:
                continue
            name = m["n"]
            if name[-2:].lower() == "by" and name[:10].lower() == "identified":
                name = "password"
            if name.lower() in ("value", "default") and (key := KEY_ATTRIBUTE.match(text, start, end)):
                name = key[1]
            kind = self._judge(name, value)
            if kind:
                give(a, b, kind, rest)
                return
            if self.strength(name) == 0:
                return
        if last == "," and LOGIN_CALL.match(text, start, end) and self.literal(value, "password", LOGIN):
            give(a, b, "login", rest)


def mask(text: str, found: list[Found], by: str = "REDACTED") -> str:
    """``text`` with every credential replaced, quotes, scheme words and key-block lines left in place.

    Of a private key the first and last line stay; a credential in pieces keeps its operators, its
    first piece becomes ``by`` and the others empty.
    """
    spans = []
    for f in found:
        if f.kind == "private key":
            begin = PEM.match(text, f.start)
            end = PEM_END.search(text, begin.end(), f.end)
            spans.append((begin.end(), end.start() if end else f.end, _body(text[begin.end() : end.start() if end else f.end], by)))
        else:
            spans += [(f.start, f.end, by), *((x, y, "") for x, y in f.more)]
    for a, b, new in sorted(spans, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def _body(body: str, by: str) -> str:
    """A key's body masked: what parts it from its first and last line stays."""
    edge = re.match(r"(?:\\n|\\r|[\s\"'+\\])*", body)[0]
    tail = re.search(r"(?:\\n|\\r|[\s\"'+\\])*$", body[len(edge) :])[0] if len(edge) < len(body) else ""
    return f"{edge}{by}{tail}"


def _run(found_only: bool, path: str | None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(path)
        for batch in batches:
            ids, paths, texts = (c.to_pylist() for c in batch.columns)
            rows = []
            for i, p, t, signs in zip(ids, paths, texts, signs_in(batch.column(2)).tolist()):
                found = finder.find(t, p or "", signs) if t else []
                if found_only:
                    rows += [(i, f.start + 1, f.kind) for f in found]
                else:
                    rows.append((i, len(found), mask(t, found) if found else t))
            columns = list(zip(*rows)) or [[]] * 3
            types = (batch.schema.field(0).type, pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types)], names=["id", "start_at" if found_only else "credentials", "kind" if found_only else "masked"])

    return run


def find_credentials(df: DataFrame, id_column: str, path_column: str, text_column: str, words: str | None = None) -> DataFrame:
    """``id``, ``start_at`` (from 1, in characters), ``kind`` of each literal credential.

    ``words`` is the path of a word-piece vocabulary, by default that of the public tokenizers. Null and
    empty texts give no row, a null path means unknown format; rows with the same id, or the same text
    twice, are each searched. Texts are searched whole, however long; other columns are ignored.
    """
    rows = df.select(F.col(id_column).alias("id"), path_column, text_column)
    return rows.mapInArrow(_run(True, words), f"id {df.schema[id_column].dataType.simpleString()}, start_at INT, kind STRING")


def mask_credentials(df: DataFrame, id_column: str, path_column: str, text_column: str, words: str | None = None) -> DataFrame:
    """``id``, ``credentials`` (their number), ``masked`` (the text with each replaced) for every row; a null text stays null."""
    rows = df.select(F.col(id_column).alias("id"), path_column, text_column)
    return rows.mapInArrow(_run(False, words), f"id {df.schema[id_column].dataType.simpleString()}, credentials INT, masked STRING")
