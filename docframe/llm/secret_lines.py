"""Labelled example lines for the credential tagger, made by a grammar of contexts and value makers.

A context is a line with fields: ``{S}`` any literal secret, ``{K}`` a hexadecimal one, ``{B}`` user and
secret in base64, ``{T}`` a token with an issuer's prefix, ``{S1}`` and ``{S2}`` halves of one, ``{L}`` one of letters only, ``{Q}`` a run of a private key
(all labelled); the others are harmless: ``{C}`` a name for a credential, ``{V}`` a name for anything else,
``{N}`` an upper-case name, ``{H}`` a host, ``{U}`` a user, ``{X}`` a harmless value in the shape of a secret, ``{P}`` a placeholder,
``{E}`` a reference, ``{I}`` an identifier, ``{D}`` a number, ``{W}`` a word, ``{Y}`` a checksum, ``{Z}`` base64 data,
``{G}`` an id, ``{R}`` a piece of prose,
``{M}`` a kind of key, ``{c}`` a short hexadecimal value, ``{a}`` an assignment sign, ``{q}`` the line's quote.

Contexts are grouped in families, so that whole families can be held out when the tagger is judged. The same shapes
of value appear as secrets and as harmless values: the tagger has to learn from the context.
"""

from __future__ import annotations

import base64
import random
import re
import string

# Prefixes that issuers give their tokens.
PREFIXES = ("ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "npm_", "pypi-", "AIza", "hf_", "dop_v1_", "SG.", "shpat_", "ya29.", "AKIA", "ASIA")
_WORDS = (
    "river apple stone cloud maple winter summer tiger falcon orange silver copper velvet garden rocket planet harbor "
    "mountain coffee purple dragon sunset monkey dolphin hunter shadow castle pepper ginger lemon cherry forest island "
    "thunder marble basket candle ladder bridge meadow pocket saddle walnut engine mirror canyon desert autumn spring "
    "apfel wolke sommer strasse brücke garten fenster blume verano lluvia piedra ciudad camino soleil maison rivière nuage montagne"
).split()
_IDS = "count index header offset buffer title range entry match result width depth limit page chunk token cell row sheet name path root style query total footer line doc glob record cursor batch worker parser handler".split()

# Names that credentials go by, in several languages, as parts of an identifier.
CREDENTIALS = (
    "password", "password", "passwd", "pass", "pwd", "pw", "passphrase", "secret", "token", "api key", "api key", "apikey", "client secret", "secret key", "secret key", "access key", "access token", "auth token", "auth key", "secret key", "secret token", "client secret", "signing key", "signing secret",
    "encryption key", "session secret", "bearer token", "refresh token", "private token", "webhook secret", "shared secret", "master key", "license key", "account key", "storage key", "admin pass", "root pw", "pin", "jwt", "credential",
    "kennwort", "passwort", "geheim", "contraseña", "contraseña", "clave", "clave secreta", "mot de passe", "motdepasse", "senha", "chave secreta", "пароль", "wachtwoord", "hasło", "heslo", "lösenord", "adgangskode", "salasana", "jelszó", "parola", "şifre",
)
_OTHER = (
    "name", "title", "path", "file", "color", "theme", "version", "checksum", "digest", "sha256", "md5", "etag", "commit", "revision", "build", "serial", "model", "order", "id", "uuid", "request id", "trace id", "session id", "object id", "public key",
    "fingerprint", "integrity", "hash", "label", "host", "user", "address", "city", "branch", "tag", "locale", "query", "pattern", "class name", "event", "topic", "bucket", "region", "author", "comment", "keyboard", "monkey", "passage", "tokenizer", "secretary", "passenger",
    "keyword", "primary key", "foreign key", "cache key", "sort key", "partition key", "lookup key", "pass count", "token count", "max tokens", "token limit", "password length", "password hint", "token type", "secret name", "key name", "key id",
)

SECRET: dict[str, tuple[str, ...]] = {
    "assignment": ("{C}{a}{q}{S}{q}", "{C}{a}{q}{K}{q}", "{C} = {q}{S}{q}", "{C} = {q}{S}{q};", "const {C} = {q}{S}{q};", "let {C} = {q}{S}{q}", "var {C} string = {q}{S}{q}", "${C} = {q}{S}{q};", "self.{C} = {q}{S}{q}", "private static final String {C} = {q}{S}{q};", "{C} := {q}{S}{q}", "if {C} == {q}{S}{q}:", "{C} = {q}{S}{q}  # {R}", "{V} = dict({C}={q}{S}{q})", "{C} = b'{S}'", "{C} = bytes.fromhex('{K}')", "{C}: str = {q}{S}{q}", "key = b'{S}'", "auto {C} = std::string({q}{S}{q});"),
    "configuration": ("{C}={S}", "{C}={S}", "{C}={S}", "{C}: {K}", "{C}={K}", "{C}: {S}", "{C}: {q}{S}{q}", "{N}_{C}={S}", "export {N}_{C}={S}", "ENV {N}_{C} {S}", "set {C} {S}", "{W}.{W}.{C}={S}", "{W}.{W}.{C}={S}", "{W}.{C}={S}", "{W}.{C} = {S}", "{C}\t{S}", "{C};{S}", "{C} {S}", "- {C}: {S}", "{C} => '{S}',", "  {C}: {S}  # {R}", "{C}|{S}", "{U}.jwt = {S}", "user={U} pass={S} host={H}", "[{W}] {C}={S}"),
    "markup": ('"{C}": "{S}",', '"{C}": "{K}",', '"{C}": "{S}"', "'{C}': '{S}',", '{"{C}":"{S}","{V}":"{X}"}', "<{C}>{S}</{C}>", '<property name="{C}" value="{S}"/>', '<add key="{C}" value="{S}" />', '<input name="{C}" value="{S}">', "define('{C}', '{S}');", '<entry key="{C}">{S}</entry>', "<string name=\"{C}\">{S}</string>"),
    "header": ("Authorization: Bearer {S}", "Authorization: Basic {B}", "Authorization: token {S}", "X-Api-Key: {S}", "x-auth-token: {S}", 'headers = {"Authorization": "Bearer {S}"}', "-H 'X-Api-Key: {S}'", 'curl -H "Authorization: Bearer {S}" https://{H}/', "Cookie: {C}={S}", "Proxy-Authorization: Basic {B}", "Authorization: ApiKey {S}"),
    "address": ("https://{H}/hook?{C}={S}&page={D}", "https://{H}/api?{V}={D}&{C}={S}", "https://{U}:{S}@{H}/{W}.git", "postgres://{U}:{S}@{H}:{D}/{W}", "mongodb://{U}:{S}@{H}/{W}", "mongodb+srv://{U}:{S}@{H}/{W}", "redis://:{S}@{H}:{D}", "redis://{U}:{S}@{H}/{D}", "mysql://{U}:{S}@{H}/{W}", "ftp://{U}:{S}@{H}/{W}", "amqp://{U}:{S}@{H}/", "{U}:{S}@{H}", "{U}:{S}@{H}:{D}/{W}", "url = {q}jdbc:{W}://{H}/{W}?user={U}&password={S}{q}", "//{H}/:_authToken={S}", "_auth={B}"),
    "command": ("curl -u {U}:{S} https://{H}/v1/{W}", "mysql -h {H} -u {U} -p{S} {W} < {W}.sql", "mysql -u {U} -p{S}", "mysqldump -u {U} -p{S} {W}", "mysql -h {H} -u {U} -p{L} {W} < {W}.sql", "mysql -u {U} -p{L} {W}", "sshpass -p {S} ssh {U}@{H}", "--{C} {S}", "--{C}={S} \\", "-e {N}_{C}={S} \\", "--set auth.{C}={S} \\", "{W} login -u {U} -p {S} {H}", "echo {S} | {W} login --password-stdin", "PGPASSWORD={S} psql -h {H} -U {U}", "net use {W} /user:{U} {S}", "openssl enc -aes-256-cbc -k {S} -in {W}.txt", "echo '{U}:{S}' | chpasswd", "zip -P {S} {W}.zip {W}"),
    "connection": ("Server={H};User Id={U};Password={S};Encrypt=true", "Data Source={H};Uid={U};Pwd={S};", "host={H} user={U} password={S} dbname={W}", "AccountKey={S};EndpointSuffix={H}", "Endpoint=sb://{H}/;SharedAccessKeyName={U};SharedAccessKey={S}", "DRIVER={W};SERVER={H};UID={U};PWD={S}", "machine {H} login {U} password {S}", "{H}:{D}:{W}:{U}:{S}"),
    "call": ("CREATE USER {U} IDENTIFIED BY '{S}';", "ALTER USER {U} WITH PASSWORD '{S}';", "requests.get(url, auth=('{U}', '{S}'))", "session.auth = ('{U}', '{S}')", "login('{U}', '{S}')", 'connect("{H}", "{U}", "{S}")', 'client := NewClient("{H}", "{U}", "{S}")', "client = Client('{H}', {C}='{S}')", "set_secret('{U}', value='{S}')", "put_parameter(Name='{W}', Value='{S}', Type='SecureString')", "$pass = ConvertTo-SecureString '{S}' -AsPlainText -Force", "DriverManager.getConnection(url, \"{U}\", \"{S}\");", "os.environ['{N}_{C}'] = '{S}'", "setenv(\"{N}_{C}\", \"{S}\", 1);", "GRANT ALL ON {W} TO {U} IDENTIFIED BY '{S}'", "smtp.login(\"{U}@{H}\", \"{S}\")", "new Credentials(\"{U}\", \"{S}\")", "verify({C}, '{S}')"),
    "note": ("# old login {U} pw {S}", "// pw: {S}", "# temporary {C} {S}", "the {C} is {S}", "{R} the {C} is {S}", "login: {U} / {S}", "# {U} / {S}", "# {R} {U} / {S}", "// {R}: {U} / {S}", "// {R}: {U} / {S}", "// {R}: {U} / {S}", "# {R}: {U} / {S}", "-- {U}:{S}", "/* {U} / {S} */", "# {C} for {H}: {S}", "{R}, {C} = {S}", "# {U} with {S}", "{C}? {S}", "// {W} {W}: {U} / {S}", "<!-- {U} / {S} -->", "log in as {U} with {C} {S}", "* {C} {S} ({R})"),
    "split": ('const key = "{S1}" + "{S2}";', "{C} = '{S1}' + '{S2}'", '{C} = "{S1}" "{S2}"', '{C} = "{S1}" . "{S2}";', "{C} = '{S1}' \\ '{S2}'"),
    "armour": ("-----BEGIN {M}PRIVATE KEY-----\\n{Q}\\n{Q}\\n-----END {M}PRIVATE KEY-----\\n", '{C}: "-----BEGIN {M}PRIVATE KEY-----\\n{Q}\\n-----END {M}PRIVATE KEY-----"', "{V} = '-----BEGIN {M}PRIVATE KEY-----\\n{Q}\\n{Q}\\n-----END {M}PRIVATE KEY-----'"),
    "bare": ("{T}", "  {T}", "{R} {T}", "{V},{T}", "{V}: {T}", "| {W} | {T} |", "{V} = {q}{T}{q}", "{U} {T} {D}", "({T})"),
}
HARMLESS: dict[str, tuple[str, ...]] = {
    "empty and placeholders": ("{C} = ''", '{C} = ""', "{C} = {P}", "{C} = {q}{P}{q}", "{C}={P}", "{C}: {P}", '"{C}": "{P}",', "export {N}_{C}={P}", "<{C}>{P}</{C}>", "Authorization: Bearer {P}", "--{C} {P}", "machine {H} login {U}", "CREATE USER {U} IDENTIFIED BY '{P}';", "Server={H};User Id={U};Password={P};Encrypt=true", "https://{U}:{P}@{H}/{W}", "# {C}: {P}", "{C}", "{C}:", "the {C} is {P}", "login: {U} / {P}"),
    "references": ("{C}: {E},", "{C}: {E},", "{C}: {E}", "{C} = {E}", "{C} = {E}", "{C} = {E};", '"{C}": {E},', "const {C} = {E};", "secret = vault.read(\"kv/{W}\")", "{C} = getpass.getpass()", "token = next(tokens)", "{C} = request.headers['X-{W}']", "token = tokenizer.next_token()", 'curl -u "$USER:$PASS" https://{H}/v1', "postgres://user:${DB_PASS}@{H}/index", "mysql -u {U} -p", "mysql -h {H} -u {U} -p {W}", "https://{U}@{H}/{W}.git", "requests.get(url, auth=(user, password))", "requests.get(url, auth=('{U}', getpass()))", "login('{U}', password)", "set_secret('{U}', value=token)", "const client = new Client('{H}', '{U}', {E});", 'client := NewClient("{H}", "{U}", os.Getenv("{N}_{C}"))', "{C} = {I}.{I}({I})", "{C} = {I}[{D}:]  # keep the {I}", "{I} = {I}[{D}:]  # keep the {C}", "{C} = {I}"),
    "numbers and code": ("max_token_count = {D}", "{I}_token = {D}", "if {I}_token > {D} {", "for token in {I}_list:", "import {I}_token", "const {I}Token = {D};", "token_{I}: {D}", "[{I}.token]", "def check_password(user, password):", "func login(user string, password string) error {", "return {I}.{I}(token, {D})", "{C} {I} {D}", '<td class="token">{I} {D}</td>', "{V} = {D}", "{I}_{I}: {D}", "{I} = {D}  # {R}", "func {I}{I}({C} string) ({I} int, err error) {", "SELECT {I}, {C} FROM {I}_log WHERE {I} > {D};", "INFO worker-{D} {I} {W}.csv {C}={D} took {D} ms", 'log.Printf("%d {C} in %s", {I}, {I}Path)', "| {C} | {I} | {D} |", "| {I} | {W}{D} | {D} |", '"{I}": "{C}-{I}",', "## {C} and {I} {D}", "const path = \"{W}\" + \"{W}\";", "// {I} {D} / {W}", "# {W} / {W}", "// {W} {W}: {I} / {W}{D}", "{D}/{D}/{D} {D}:{D}", "{W}:{D}", "{W}-{W}{D}", "http://{H}:{D}/{W}/{W}", "https://{H}/docs?page={D}&sort=name", "https://{H}/search?q={W}&token_type=bearer", "assert {C} != {q}{q}", "class {C}Error(Exception):", "{C} -> {C}", "return {q}{W}{q}", "print({q}{R}{q})", "raise ValueError({q}{C} {W}{q})"),
    "checksums and ids": ("{V} = '{Y}'", "{V} = {q}{X}{q}", "{V}: {X}", "{V}={X}", '"{V}": "{X}",', "{V} {X}", "{V} = {q}{Y}{q}", "{V} = {q}{Y}{q}", "etag = {q}{Y}{q}", "{V}: {Y}", '"{V}": "{Y}"', "sha256:{Y}  {W}.tar", "md5: {Y}", "{Y}  {W}.zip", "commit {Y}", "Merge commit {Y} into main", 'ETag: "{Y}"', '"integrity": "sha512-{Z}",', "integrity sha1-{Z}", "digest: sha256:{Y}", "id: {G}", "request_id={G}", '"uuid": "{G}",', "trace id {G}", "session: {G} started", "{V}: {G}", "build {X} finished", '"hash": "{Y}"', "checksum = '{Y}'", "key: {W}", "primary_key = '{I}_id'", "foreign key ({I}_id)", "ssh-ed25519 {Z} {U}@{W}", "ssh-rsa {Z} {U}@{H}", "ssh-rsa {Z}", 'public_key = "ssh-ed25519 {Z} {U}@laptop"', "-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", "-----BEGIN PUBLIC KEY-----\\n{Z}\\n-----END PUBLIC KEY-----", "# paste the -----BEGIN PRIVATE KEY----- block here", "fingerprint: SHA256:{Z}", 'src="data:image/png;base64,{Z}"', "url(data:font/woff2;base64,{Z})", "{Z}", "{Z}", "{Z}", "{Z}", "{Z}", "{Z}", "{Z}", "{Z}", "{Y}", "{Y}", "{G}", "{X}", "serial {X}", "order no. {X}", "color = '#{c}'", 'version = "{D}.{D}.{D}"', '<script src="/static/{W}.{X}.js"></script>', '<add key="PageSize" value="{D}" />', '<add key="Theme" value="{W}" />', "bytes.fromhex('{c}')", "{W}/{X}/{Y}", "{V}, {X}, {D}"),
    "prose": ("{R}", "{R}", "# {R}", "# {R}", "// {R}", "# {W}: {R}", "// {W}: {R}", "# {W} {D} - {R}", "* {R}", "{R}.", "{R} {R}.", "The {C} must have {D} characters.", "enter your {C} and press return", "the token count is {D}", "{R} {C} {R}.", "// {R}", "# {R}", "* {W}: {R}", "{W}: {R}", "{R}: {W} / {W}", '<label for="{C}">{W}</label>', 'label for="{C}">{R}</label>', '<input type="password" name="{C}">', "{V} - {R}", 'print("{R} {D} - {R}', 'title: "{R} {D} - {R}', "author: {W}", "// removes the {W} from the {W}", "# {V} {D} - {R}", "{R}, {R}; {R}"),
}

_CERTAIN = re.compile(r"""\{q\}\{S\}\{q\}|["'=:>] ?\{S\}""")
LABELLED = frozenset(("S", "S1", "S2", "B", "K", "T", "Q", "L"))
_FIELD = re.compile(r"\{([A-Za-z][12]?)\}")
_LETTERS = ("aeiou bcdfghlmnprstvz", "aeiouäöüéèêáíóúñçßåøœ bcdfghjklmnpqrstvwxz", "аеиоуыэюя бвгджзклмнпрстхцчшщ", "ÃÂÐÑâãåæçèéÅÄ ¤¶¼½¾¿±³´µ·¸ºœžŸ§©ª«¬®°", "αεηιοω βγδκλμνπρστφχ")


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def mixed(self, n: int, chars: str = string.ascii_letters + string.digits) -> str:
        return "".join(self.r.choices(chars, k=n))

    def name(self, parts: str) -> str:
        """An identifier of some words, in one of the usual spellings, perhaps with a word before or after."""
        r = self.r
        words = parts.split()
        if r.random() < 0.3:
            words.insert(0, r.choice((*_IDS, "db", "smtp", "user", "admin", "app", "my", "new", "ldap")))
        k = r.random()
        if k < 0.45:
            return "_".join(words)
        if k < 0.6:
            return "_".join(words).upper()
        if k < 0.78:
            return words[0] + "".join(w.capitalize() for w in words[1:])
        if k < 0.9:
            return "-".join(words)
        return "".join(w.capitalize() for w in words) if k < 0.95 else " ".join(words)

    def secret(self, weak: bool = True) -> str:
        """A secret; short ones, numbers and plain words only where the context leaves no doubt (``weak``)."""
        r, k = self.r, self.r.random()
        if k < 0.27:
            w = r.choice(_WORDS)
            w = r.choice((w, w.capitalize(), w.upper()))
            return w + r.choice(("", "-", "_", ".", ".")) + r.choice(("", r.choice(_WORDS), r.choice(_WORDS))) + str(r.randint(1, 9999)) + r.choice(("", "!", "#", "$", "*", "?", "%"))
        if k < 0.33 and weak:
            return r.choice((self.mixed(r.randint(3, 6), string.ascii_lowercase + string.digits), str(r.randint(100, 999999)), r.choice(_WORDS), r.choice(_WORDS) + r.choice("!?#123")))
        if k < 0.40:
            return self.mixed(r.randint(8, 20), string.ascii_letters + r.choice((string.digits, string.digits, "")) + "!#$%*^_-")
        if k < 0.55:
            return self.mixed(r.randint(8, 27), r.choice((string.ascii_letters, string.ascii_letters + string.digits, string.ascii_letters + string.digits, string.ascii_uppercase + string.digits if r.random() < 0.3 else string.ascii_letters + string.digits)))
        if k < 0.68:
            return self.issued()
        if k < 0.75:
            return base64.b64encode(r.randbytes(r.choice((18, 24, 30, 32, 48)))).decode()
        if k < 0.86:
            return self.mixed(r.choice((32, 40, 64)), "0123456789abcdef")
        if k < 0.92:
            return self.uuid()
        if k < 0.95:
            return "eyJ" + self.mixed(r.randint(16, 40)) + "." + "eyJ" + self.mixed(r.randint(16, 60)) + "." + self.mixed(43, string.ascii_letters + string.digits + "-_")
        return "xoxb-" + str(r.randint(10**10, 10**12)) + "-" + self.mixed(24)

    def issued(self) -> str:
        p = self.r.choice(PREFIXES)
        return p + (self.mixed(16, string.ascii_uppercase + ("" if self.r.random() < 0.3 else string.digits)) if p in ("AKIA", "ASIA") else self.mixed(self.r.choice((16, 20, 24, 32, 35, 36)), string.ascii_letters + string.digits + self.r.choice(("", "", "-_"))))

    def uuid(self) -> str:
        return "-".join(self.mixed(n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))

    def prose(self) -> str:
        """Some invented words of one alphabet, long ones among them; or plain words."""
        r = self.r
        if r.random() < 0.35:
            return " ".join(r.choice((*_WORDS, *_IDS, "the", "a", "of", "and", "before", "remove", "release", "old", "later", "todo", "fix", "see")) for _ in range(r.randint(1, 6)))
        vowels, others = r.choice(_LETTERS).split()
        words = ["".join(r.choice(others) + r.choice(vowels) + (r.choice(others) if r.random() < 0.4 else "") for _ in range(r.choice((1, 1, 2, 2, 3, 4, 6, 8)))) for _ in range(r.randint(1, 9))]
        words = [r.choice("ldLDnQ") + "'" + w if r.random() < 0.08 else w for w in words]
        if r.random() < 0.5:
            words = [w[0].upper() + w[1:] if r.random() < 0.3 else w for w in words]
        text = " ".join(w + r.choice(("", "", "", "", "", "", ",", "?", "!", ".", ":")) for w in words)
        if r.random() < 0.5:  # read with the wrong code page, perhaps twice, or with letters lost
            page = r.choice(("cp1252", "latin-1", "mac-roman", "cp437", "cp1250", "cp1251", "ascii"))
            for _ in range(r.choice((1, 1, 2))):
                text = text.encode("utf-8", "ignore").decode(page, "replace" if page == "ascii" else "ignore")
        return text

    def field(self, kind: str) -> str:
        r = self.r
        if kind == "P":
            return r.choice(("<your-password>", "<password>", "{{ password }}", "${PASSWORD}", "%PASSWORD%", "xxxxxxxx", "********", "changeme", "your_password_here", "REDACTED", "$PASSWORD", "TODO", "null", "None", "...", "<secret>", "${DB_PASS}", "{{ vault_token }}", "[hidden]", "example", "$(cat /run/secrets/pw)", "<token>", "${TOKEN}", "XXXX", "***", "false", "true", "none", "n/a"))
        if kind == "E":
            n = self.name(r.choice(CREDENTIALS)).upper().replace("-", "_").replace(" ", "_")
            return r.choice((f"process.env.{n}", f'os.environ["{n}"]', f"os.environ['{n}']", f"os.getenv('{n}')", f"config.get('{n.lower()}')", f"settings.{n}", f'System.getenv("{n}")', f"ENV['{n}']", f"args.{n.lower()}", f"self.{n.lower()}", f"${{{n}}}", f"${n}", f"secrets.{n}", f"data.vault.{n.lower()}.value"))
        if kind == "H":
            return r.choice((f"{r.choice(_WORDS)}.{r.choice(_WORDS)}.example", f"db{r.randint(1, 9)}.{r.choice(_WORDS)}.test", f"10.{r.randint(0, 99)}.{r.randint(0, 99)}.{r.randint(1, 99)}", f"{r.choice(_WORDS)}.invalid", "localhost"))
        if kind == "X":
            return r.choice((self.mixed(r.randint(8, 12), string.ascii_uppercase + string.digits), r.choice(_WORDS).capitalize() + str(r.randint(1, 9999)), self.mixed(r.randint(6, 20)), self.mixed(r.choice((8, 12, 40)), "0123456789abcdef"), f"{r.choice(_WORDS)}-{r.choice(_WORDS)}{r.randint(1, 99)}", self.uuid(), f"v{r.randint(0, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}", f"{r.choice(_WORDS)}.{r.choice(_IDS)}"))
        if kind == "Y":
            return self.mixed(r.choice((32, 40, 40, 64, 64)), "0123456789abcdef")
        if kind == "Z":
            return r.choice(("", "", "AAAAC3NzaC1lZDI1NTE5AAAAI", "AAAAB3NzaC1yc2EAAAADAQAB", "iVBORw0KGgo")) + base64.b64encode(r.randbytes(r.randint(7, 64))).decode().rstrip(r.choice("=-"))
        if kind == "B":
            return base64.b64encode(f"{r.choice(_WORDS)}:{self.secret()}".encode()).decode()
        if kind == "Q":
            return self.mixed(r.choice((40, 64)), string.ascii_letters + string.digits + "+/")
        if kind == "C":
            name = self.name(r.choice(CREDENTIALS))
            if not name.isascii() and r.random() < 0.4:  # names of a text read with the wrong code page
                return name.encode().decode(r.choice(("cp1252", "latin-1", "mac-roman")), "ignore")
            return name
        makers = {
            "S": self.secret, "L": lambda: self.mixed(r.randint(8, 16), string.ascii_letters), "K": lambda: self.mixed(r.choice((32, 40, 64)), "0123456789abcdef"), "T": self.issued,
            "S1": lambda: r.choice((r.choice(PREFIXES) + self.mixed(16), self.mixed(r.randint(8, 20)), self.mixed(20, "0123456789abcdef"))), "S2": lambda: self.mixed(r.randint(8, 20), r.choice((string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"))), "G": self.uuid, "M": lambda: r.choice(("", "RSA ", "EC ", "ENCRYPTED ", "OPENSSH ")),
            "N": lambda: r.choice(_WORDS + _IDS).upper(), "U": lambda: r.choice(("admin", "root", "user", "guest", "deploy", "app", "svc_" + r.choice(_IDS), r.choice(_WORDS), "docs_ro", "batch", "reporter", "exporter", "postgres", r.choice(_WORDS) + "@" + r.choice(_WORDS) + ".test")),
            "V": lambda: self.name(r.choice(_OTHER)), "I": lambda: r.choice(_IDS), "D": lambda: str(r.randint(0, 10 ** r.randint(1, 5))), "W": lambda: r.choice(_WORDS + _IDS), "R": self.prose,
            "c": lambda: self.mixed(r.choice((6, 8)), "0123456789abcdef"), "a": lambda: r.choice((" = ", "=", ": ", " := ", " => ")),
        }
        return makers[kind]()

    def line(self, context: str) -> tuple[str, list[tuple[int, int]]]:
        """A line and the character spans of its secrets."""
        out, spans, at = self.r.choice(("", "", "", "    ", "        ", "\t")), [], 0
        quote, weak = self.r.choice(("'", '"', '"', "'", "`")), bool(_CERTAIN.search(context))
        for m in _FIELD.finditer(context):
            out += context[at : m.start()]
            value = quote if m[1] == "q" else self.secret(weak) if m[1] == "S" else self.field(m[1])
            if m[1] in LABELLED:
                spans.append((len(out), len(out) + len(value)))
            out += value
            at = m.end()
        return out + context[at:], spans


def examples(n: int, seed: int = 7, without: str = "", only: str = "") -> list[tuple[str, list[tuple[int, int]]]]:
    """``n`` labelled lines, a little under half of them with secrets; a documented, fixed bound of the model's training set.

    ``without`` leaves a family of contexts out; ``only`` makes lines of that one alone.
    """
    m = Maker(seed)
    secret = [v for k, v in SECRET.items() if k != without and only in ("", k)]
    harmless = [v for k, v in HARMLESS.items() if k != without and only in ("", k)]
    out = []
    for i in range(n):
        families = secret if (i % 9 < 4 or not harmless) and secret else harmless
        weights = [len(f) ** 0.7 for f in families]
        out.append(m.line(m.r.choice(m.r.choices(families, weights)[0])))
    return out
