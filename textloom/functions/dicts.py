"""Word lists of the lexical levels. Order matters where one entry's key could be part of another's."""

from __future__ import annotations

# Keys and replacements that results must have.
ABBREVIATIONS = {
    "configuration": "config", "configurations": "configs", "repository": "repo", "directory": "dir",
    "directories": "dirs", "environment": "env", "parameters": "params", "parameter": "param", "argument": "arg",
    "arguments": "args", "function": "fn", "functions": "fns", "initialize": "init", "initialization": "init",
    "information": "info", "message": "msg", "messages": "msgs", "database": "db", "application": "app",
    "applications": "apps", "temporary": "temp", "maximum": "max", "minimum": "min", "asynchronous": "async",
    "synchronous": "sync", "reference": "ref", "references": "refs", "implementation": "impl",
    "authentication": "auth", "authorization": "authz", "dependency": "dep", "dependencies": "deps",
    "repositories": "repos", "variable": "var", "variables": "vars", "string": "str", "integer": "int",
    "boolean": "bool", "request": "req", "response": "res", "error": "err", "errors": "errs", "exception": "ex",
    "exceptions": "exs", "documentation": "docs", "document": "doc",
    "implement a solution for": "fix", "create a new": "make", "make a new": "make", "set up": "setup",
    "figure out": "find", "look into": "check",
    "extensive": "big", "massive": "huge", "complicated": "hard", "difficult": "hard", "straightforward": "easy",
    "simple": "easy",
}
BRUTAL = {
    "is equal to": "=", "equals": "=", "greater than": ">", "less than": "<", "and": "&", "or": "|", "with": "w/",
    "without": "w/o", "because": "cuz", "number": "#", "check": "chk", "update": "upd", "delete": "del",
    "remove": "rm", "create": "mk", "make": "mk",
}
ENGLISH = {
    "approximately": "approx", "maximum": "max", "minimum": "min", "average": "avg", "total": "tot", "number": "num",
    "amount": "amt", "quantity": "qty", "percentage": "pct", "seconds": "secs", "milliseconds": "ms",
    "microseconds": "us", "nanoseconds": "ns", "administrator": "admin", "organization": "org",
    "organizations": "orgs", "department": "dept", "management": "mgmt", "operations": "ops", "specification": "spec",
    "specifications": "specs", "performance": "perf", "notification": "notif", "notifications": "notifs",
    "transaction": "txn", "transactions": "txns", "timestamp": "ts", "identifier": "id", "attribute": "attr",
    "attributes": "attrs", "property": "prop", "properties": "props", "description": "desc", "descriptions": "descs",
    "calculation": "calc", "calculations": "calcs", "validation": "validation", "validations": "validations",
    "communication": "comm", "communications": "comms", "concatenation": "concat", "initialization": "init",
    "synchronization": "sync", "serialization": "serial", "deserialization": "deserial", "configuration": "config",
    "configurations": "configs", "transformation": "transform", "transformations": "transforms",
    "authentication": "auth", "authorization": "authz", "documentation": "docs", "implementation": "impl",
    "implementations": "impls",
    "for example": "e.g.", "that is": "i.e.", "and so on": "etc.", "et cetera": "etc.", "as well as": "&",
    "in addition to": "+", "in order to": "to", "as a result": "thus", "in other words": "i.e.",
    "with respect to": "re:", "with regard to": "re:", "as opposed to": "vs", "compared to": "vs",
    "as compared to": "vs", "versus": "vs", "at least": ">=", "at most": "<=", "greater than": ">", "less than": "<",
    "equal to": "=", "not equal": "!=", "true or false": "bool", "true and false": "bool",
}
#: The commonest words; EngineConfig.indonesian takes a whole dictionary.
INDONESIAN = {
    "yang": "yg", "dengan": "dgn", "untuk": "utk", "tidak": "tdk", "sudah": "sdh", "belum": "blm", "tetapi": "tapi",
    "karena": "krn", "sehingga": "shg", "sebagai": "sbg", "terhadap": "thdp", "menjadi": "mjd",
    "melakukan": "mlkkn", "menggunakan": "mggn", "berdasarkan": "brdskn", "merupakan": "mrpkn", "sebelum": "sblm",
    "sesudah": "ssdh", "antara": "antr", "dalam": "dlm", "dapat": "dpt", "harus": "hrs", "akan": "akn", "juga": "jg",
}
INDONESIAN_MARKS = ("yang", "dengan", "untuk", "tidak", "sudah", "adalah", "dalam", "dari")
#: Replaced one after another, as plain text.
JAPANESE = {
    "おねがいします": "おねが", "ありがとうございます": "あざす", "ありがとう": "あり", "すみません": "すみ",
    "すみませんが": "すみが", "おはようございます": "おはよ", "おやすみなさい": "おやすみ", "いってらっしゃい": "いってら",
    "おかえりなさい": "おかえり", "しました": "した", "しています": "してる", "していました": "してた", "できます": "でき",
    "できました": "できた", "いきます": "いく", "いきました": "いった", "きます": "くる", "きました": "きた",
    "みます": "みる", "みました": "みた", "います": "いる", "いました": "いた", "あります": "ある", "ありました": "あった",
    "わかります": "わかる", "わかりました": "わかった", "おもいます": "おもう", "おもいました": "おもった",
    "かかります": "かかる", "かかりました": "かかった", "それでは": "では", "それから": "それで", "ことができる": "できる",
    "つまり": "つま", "ください": "くれ", "しかし": "が", "ところで": "とこで", "いずれにしても": "ともかく",
    "いずれにせよ": "ともかく", "どちらにしても": "ともかく", "どちらにせよ": "ともかく", "ようするに": "つまり",
    "そのうえ": "さらに", "けれども": "けど", "だけれど": "だけど", "もっとも": "ただ", "ちょっと待って": "ちょ待",
    "たった今": "今", "このあいだ": "先日", "ほんとうに": "ほんと", "まじで": "マジ", "たぶん": "たぶ",
    "もしかして": "もしか", "そうですね": "そですね", "そうですか": "そですか", "えーと": "えー",
}
FILLERS = ("just", "really", "basically", "actually", "simply", "quite", "very", "essentially", "literally")
PLEASANTRIES = ("please", "kindly", "thank you", "thanks", "sure", "certainly", "of course", "happy to", "i'?d be happy")
HEDGES = ("perhaps", "maybe", "might", "could potentially", "would like to", "i think", "in my opinion", "it seems", "it appears")
OPENERS = ("i'?ll", "i will", "i can", "i'?d", "you can", "we will", "we can", "let me", "let'?s")
ARTICLES = ("a", "an", "the")
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "of", "to", "in", "for", "with", "on", "at", "from", "by")


def singles(words: dict[str, str]) -> dict[str, str]:
    """Entries of one word: no result of one is a key, so all are looked up at once."""
    return {k: v for k, v in words.items() if k.isascii() and k.replace("_", "a").isalnum()}


def phrases(words: dict[str, str]) -> dict[str, str]:
    """The others, in order."""
    one = singles(words)
    return {k: v for k, v in words.items() if k not in one}
