"""Scalar projections over records, messages and packet events. Columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netlens.functions import names


def ns_to_ms(ns: Column) -> Column:
    """Milliseconds as a double; null stays null."""
    return ns / F.lit(1e6)


def _clock(ns: Column, pattern: str) -> Column:
    """Text of the second that holds ns, in UTC whatever the session's zone is."""
    seconds = (ns - F.pmod(ns, F.lit(10**9))) / F.lit(10**9)
    return F.date_format(F.timestamp_add("SECOND", seconds.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), pattern)


def rfc3339_nano(ns: Column) -> Column:
    """2024-01-01T00:00:07.179575Z: the fraction without closing zeros, none at whole seconds."""
    fraction = F.regexp_replace(F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"), "0+$", "")
    return F.concat(_clock(ns, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def _millis(ns: Column) -> Column:
    return F.lpad(F.floor(F.pmod(ns, F.lit(10**9)) / F.lit(10**6)).cast("string"), 3, "0")


def date_time_ms(ns: Column) -> Column:
    return F.concat(_clock(ns, "yyyy-MM-dd HH:mm:ss"), F.lit("."), _millis(ns))


def time_ms(ns: Column) -> Column:
    return F.concat(_clock(ns, "HH:mm:ss"), F.lit("."), _millis(ns))


def truncated(text: Column, size: int) -> Column:
    """Texts of `size` bytes or more are cut to that many bytes and say how long they were."""
    n = F.octet_length(text)
    cut = F.substring(text.cast("binary"), 1, size).cast("string")
    return F.when(n < size, text).otherwise(F.concat(cut, F.lit("...(truncated, total: "), n.cast("string"), F.lit("bytes)")))


def address(host: Column, port: Column) -> Column:
    return F.concat(host, F.lit(":"), port.cast("string"))


def connection_label(local_addr: Column, local_port: Column, remote_addr: Column, remote_port: Column, side: Column) -> Column:
    arrow = F.when(side == "client", F.lit(" => ")).otherwise(F.lit(" <= "))
    return F.concat(address(local_addr, local_port), arrow, address(remote_addr, remote_port))


def connection_key(local_addr: Column, local_port: Column, remote_addr: Column, remote_port: Column) -> Column:
    """Identity of a connection: both ends, not the process and not the side."""
    return F.concat_ws("|", local_addr, local_port.cast("string"), remote_addr, remote_port.cast("string"))


def pid_of(tgid_fd: Column) -> Column:
    return F.shiftright(tgid_fd, 32)


def fd_of(tgid_fd: Column) -> Column:
    return tgid_fd.bitwiseAND(F.lit(0xFFFFFFFF))


def displayed(value: Column) -> Column:
    """Two decimals; a dash for what is missing."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string("%.2f", value.cast("double")))


def ipv4_text(raw: Column) -> Column:
    """Four bytes to dotted decimal."""
    parts = [F.conv(F.substring(F.hex(raw), 2 * i + 1, 2), 16, 10) for i in range(4)]
    return F.concat_ws(".", *parts)


def ipv6_text(raw: Column) -> Column:
    """Sixteen bytes as text: groups of lower-case hex without leading zeros, the longest run of two or more zero groups (the first of equal
    ones) folded to ::, and what stands for an IPv4 address (::ffff:0:0/96) dotted."""
    # three passes over one text, each of which takes the one before once: what repeats its input outgrows compiled code
    whole = F.concat(F.regexp_replace(F.lower(F.hex(raw)), "000(.)|00(..)|0(...)|(....)", ":$1$2$3$4"), F.lit(":"))
    folded = F.regexp_replace(whole, r"^(.*?)((?::0){2,}+)(?!.*\2:0):(.*)$", "$1::$3")
    mapped = F.substring(F.hex(raw), 1, 24) == "0" * 20 + "FFFF"
    return F.when(mapped, ipv4_text(F.substring(raw, 13, 4))).otherwise(F.regexp_replace(folded, "^:(?!:)|(?<!:):$", ""))


def ip_text(raw: Column) -> Column:
    return F.when(F.octet_length(raw) == 4, ipv4_text(raw)).when(F.octet_length(raw) == 16, ipv6_text(raw))


def dns_flag(flags: Column, pos: int, mask: int) -> Column:
    return F.shiftright(flags, pos).bitwiseAND(F.lit(mask))


# Places and masks of the DNS header's flags.
DNS_FLAGS = {"rcode": (0, 0xF), "cd": (4, 1), "ad": (5, 1), "ra": (7, 1), "rd": (8, 1), "tc": (9, 1), "aa": (10, 1), "opcode": (11, 0xF), "qr": (15, 1)}


def http_method(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^([A-Z]+) [^ ]+ HTTP/", 1), F.lit(""))


def http_path(text: Column) -> Column:
    """The request target up to its query."""
    return F.nullif(F.substring_index(F.regexp_extract(text, r"^[A-Z]+ ([^ ]+) HTTP/", 1), "?", 1), F.lit(""))


def http_host(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)\r\nHost: *([^\r\n]+)", 1), F.lit(""))


def _resp_words(text: Column) -> Column:
    """Values of an array of bulk strings: every second line after the first."""
    lines = F.split(text, "\r\n")
    return F.filter(lines, lambda x, i: (i > 0) & (i % 2 == 0) & (i < F.size(lines) - 1))


def redis_fields(text: Column) -> Column:
    """struct<command, payload, failed>: a command of one word or two, in upper case, and the rest joined by blanks. Simple strings,
    errors and numbers have no command."""
    words = _resp_words(text)
    first, second = F.upper(F.get(words, F.lit(0))), F.upper(F.get(words, F.lit(1)))
    two = first.isin(names.REDIS_TWO_WORDS) & second.isNotNull()
    array = text.startswith("*")
    command = F.when(array & two, F.concat_ws(" ", first, second)).when(array, first)
    rest = F.slice(words, F.when(two, F.lit(3)).otherwise(F.lit(2)), F.lit(1 << 20))
    payload = F.when(array, F.array_join(rest, " ")).otherwise(F.regexp_extract(text, r"^[+:-](.*)\r\n$", 1))
    return F.struct(command.alias("command"), payload.alias("payload"), text.startswith("-").alias("failed"))


def redis_key(payload: Column) -> Column:
    return F.substring_index(payload, " ", 1)


def _number(raw: Column, at: int, size: int, little: bool = False) -> Column:
    h = F.substring(F.hex(raw), 2 * at + 1, 2 * size)
    if little:
        h = F.concat(*[F.substring(h, 2 * (size - 1 - i) + 1, 2) for i in range(size)])
    return F.conv(h, 16, 10).cast("long")


#: Leading and closing bytes of a read that protocol_tag() looks at.
TAG_HEAD, TAG_TAIL = 17, 2


def protocol_tag(raw: Column, size: Column | None = None, total: Column | None = None, before: Column | None = None, tail: Column | None = None) -> Column:
    """struct<protocol int, message string, prepended boolean> from the leading bytes of a read, the first rule that holds; message is req,
    resp or any.

    `before` is the read just before on the connection, if that had four bytes, else null: MySQL and Kafka peers read a message's
    length first, and the bytes after it then begin in the message. prepended says that they did (Kafka), so that the length
    belongs in front. Of cut reads give size (captured), total (bytes of the whole call) and tail (the last two captured bytes).
    """
    n, head, mask31 = F.octet_length(raw) if size is None else size, F.substring(raw, 1, 4).cast("string"), 1 << 31
    total, before, last = n if total is None else total, F.lit(None).cast("binary") if before is None else before, F.substring(F.hex(raw), -4, 4) if tail is None else F.hex(tail)
    http_req = (n >= 5) & (F.substring(head, 1, 3).isin("GET") | head.isin("HEAD", "POST"))
    http_resp = (n >= 5) & (head == "HTTP")
    mongo_len, mongo_id, mongo_to, mongo_op = (_number(raw, 4 * i, 4, little=True) for i in range(4))
    mongo = (n >= 16) & mongo_len.between(16, mask31 - 1) & (mongo_id < mask31) & (mongo_to == 0) & mongo_op.isin(2001, 2002, 2003, 2004, 2005, 2006, 2007, 2012, 2013)
    told = F.coalesce(_number(before, 0, 4, little=True) == n, F.lit(False))
    first = lambda here, there: F.when(told, there).otherwise(here)
    mysql = ((n + F.when(told, 4).otherwise(0) >= 5) & (first(_number(raw, 3, 1), _number(before, 3, 1)) == 0) & first(_number(raw, 0, 3, little=True), _number(before, 0, 3, little=True)).between(1, 10000)
             & first(_number(raw, 4, 1), _number(raw, 0, 1)).isin(0x03, 0x0B, 0x16, 0x17, 0x19))
    frame, header = _number(raw, 0, 4), _number(raw, 4, 4)
    kind, length = F.shiftright(header, 24), header.bitwiseAND(F.lit(0xFFFFFF))
    by_kind = F.when(kind == 0, F.substring(raw, 9, 8).cast("string") == '{"code":').when(kind == 1, (_number(raw, 8, 2) >= 10) & (_number(raw, 10, 1) <= 13)).otherwise(F.lit(False))
    rocketmq = (n >= 16) & frame.between(1, mask31 - 1) & (frame <= n - 4) & (length > 0) & (length == frame - 4) & by_kind
    ahead = F.coalesce((_number(before, 0, 4) == n) | (_number(before, 0, 4) == total), F.lit(False))
    body = lambda at, width: F.when(ahead, _number(raw, at, width)).otherwise(_number(raw, 4 + at, width))
    kafka = (n + F.when(ahead, 4).otherwise(0) >= 12) & (ahead | (frame + 4 == n) | (frame + 4 == total)) & body(0, 2).between(0, 62) & body(2, 2).between(0, 17) & (body(4, 4) < mask31)
    flags = _number(raw, 2, 2)
    q, a, auth, more = (_number(raw, 4 + 2 * i, 2) for i in range(4))
    dns = n.between(12, 512) & (dns_flag(flags, 6, 1) == 0) & (dns_flag(flags, 11, 15) == 0) & q.between(1, 10) & (q + a + auth + more <= 25)
    redis = (n >= 3) & F.substring(head, 1, 1).isin("+", "-", ":", "$", "*") & (last == "0D0A")
    rule = lambda code, message, prepended=F.lit(False): F.struct(F.lit(code).alias("protocol"), F.lit(message).alias("message"), prepended.alias("prepended"))
    return (F.when(http_resp, rule(names.HTTP, "resp")).when(http_req, rule(names.HTTP, "req")).when(mongo, rule(names.MONGO, "req")).when(mysql, rule(names.MYSQL, "req"))
            .when(rocketmq, rule(names.ROCKETMQ, "req")).when(kafka, rule(names.KAFKA, "req", ahead)).when(dns & (dns_flag(flags, 15, 1) == 0), rule(names.DNS, "req"))
            .when(dns, rule(names.DNS, "resp")).when(redis, rule(names.REDIS, "any")))


#: What stands where bytes were not captured; a four-byte length follows.
UNCAPTURED = "__FAKE_DATA__"


def is_partial(payload: Column, length: Column, captured: Column) -> Column:
    """Whether a message lacks bytes: the marker stands in it, or more was sent than was captured."""
    return F.coalesce(F.instr(payload, UNCAPTURED) > 0, F.lit(False)) | F.coalesce(length > captured, F.lit(False))


def is_request(side: Column, egress: Column) -> Column:
    """What a client sends and what a server receives."""
    return F.when(side == "client", egress).otherwise(~egress)


def message_time(start: Column, delta: Column, side: Column, request: Column) -> Column:
    """Of a syscall that took delta: its start for what is written, its end for what is read."""
    written = (side == "client") == request
    return F.when(written, start).otherwise(start + delta)


def response_status(protocol: Column, redis_failed: Column, mysql_status: Column, http_code: Column | None = None) -> Column:
    """HTTP always succeeds, unless a status code is given to judge by (400 and more fail)."""
    http = F.lit(names.SUCCESS) if http_code is None else F.when(http_code >= 400, F.lit(names.FAIL)).otherwise(F.lit(names.SUCCESS))
    return (F.when(protocol == names.HTTP, http).when(protocol == names.REDIS, F.when(redis_failed, F.lit(names.FAIL)).otherwise(F.lit(names.SUCCESS)))
            .when(protocol == names.MYSQL, F.coalesce(mysql_status, F.lit(names.UNKNOWN))).otherwise(F.lit(names.SUCCESS)))


# Label keys of containers.
SANDBOX_LABEL, POD_LABEL, NAMESPACE_LABEL, KIND_LABEL = "io.kubernetes.docker.type", "io.kubernetes.pod.name", "io.kubernetes.pod.namespace", "io.cri-containerd.kind"


def container_name(name: Column) -> Column:
    return F.ltrim(name, F.lit("/"))


def is_sandbox(labels: Column) -> Column:
    return F.coalesce(F.element_at(labels, SANDBOX_LABEL) == "podsandbox", F.lit(False)) | F.coalesce(F.element_at(labels, KIND_LABEL) == "sandbox", F.lit(False))


def without_namespace(pid_ns: Column, mnt_ns: Column, net_ns: Column) -> Column:
    return (F.coalesce(pid_ns, F.lit(0)) == 0) & (F.coalesce(mnt_ns, F.lit(0)) == 0) & (F.coalesce(net_ns, F.lit(0)) == 0)


def interface_name(key: Column) -> Column:
    return F.regexp_replace(key, "^time-", "")


def process_label(pid: Column, name: Column) -> Column:
    return F.concat(pid.cast("string"), F.lit("<"), F.coalesce(name, F.lit("")), F.lit(">"))


def request_summary(protocol: Column, method: Column, host: Column, path: Column, command: Column, payload: Column, text: Column) -> Column:
    """One line for a request: HTTP by its address; Redis whole under 128 characters, else command and key; others their text."""
    http = F.concat(F.lit("[HTTP] "), method, F.lit(" http://"), host, path)
    short = F.length(command) + F.length(payload) < 128
    redis = F.when(short, F.concat(F.lit("[Redis] "), command, F.lit(" "), payload)).when(F.instr(payload, " ") > 0, F.concat(F.lit("[Redis] "), command, F.lit(" "), redis_key(payload))).otherwise(command)
    return F.when(protocol == names.HTTP, http).when(protocol == names.REDIS, redis).otherwise(text)


def dns_type_name(code: Column) -> Column:
    return F.when(code == 1, F.lit("A")).when(code == 28, F.lit("AAAA")).otherwise(F.lit("UNKNOWN"))


def mysql_text(base: Column, status: Column, message: Column) -> Column:
    return F.concat(F.lit("base=["), base, F.lit("] status=["), status.cast("string"), F.lit("] Msg=["), message, F.lit("]"))


def mongo_text(base: Column, body: Column) -> Column:
    return F.concat(F.lit("MongoDB base=["), base, F.lit("]  Msg=["), body, F.lit("]"))


def rocketmq_text(base: Column, code: Column, language: Column, version: Column, opaque: Column, flag: Column, remark: Column, properties: Column, body: Column) -> Column:
    """properties is a map; its entries are shown in order of their keys."""
    entries = F.transform(F.array_sort(F.map_entries(properties)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    shown = F.when(F.size(entries) > 0, F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))).otherwise(F.lit(""))
    numbers = [x for name, column in (("code", code), ("language", language), ("version", version), ("opaque", opaque), ("flag", flag)) for x in (F.lit(f"{name}="), column.cast("string"), F.lit(", "))]
    return F.concat(F.lit("base=["), base, F.lit("] detail=["), *numbers, F.lit("remark="), remark, F.lit(", extFields="), shown, F.lit(", body="), body, F.lit("]"))


def dns_text(txid: Column, flags: Column, queries: Column, answers: Column, authorities: Column, additional: Column, records: Column) -> Column:
    """records is an array<struct<name, cname, type>>, shown as indented JSON."""
    one = lambda r: F.concat(F.lit('  {\n    "name": "'), r["name"], F.lit('",\n    "cname": "'), F.coalesce(r["cname"], F.lit("")), F.lit('",\n    "type": '), r["type"].cast("string"), F.lit("\n  }"))
    shown = F.when(F.size(records) > 0, F.concat(F.lit("[\n"), F.array_join(F.transform(records, one), ",\n"), F.lit("\n]"))).otherwise(F.lit("null"))
    head = [x for name, column in (("TXID", txid), ("Flags", flags), ("NumQueries", queries), ("NumAnswers", answers), ("NumAuth", authorities), ("NumAddl", additional)) for x in (F.lit(f"{name}="), column.cast("string"), F.lit(", "))]
    return F.concat(F.lit("DNS Frame: "), *head, F.lit("Records="), shown)


def kafka_text(base: Column, api: Column, version: Column, client: Column, message: Column) -> Column:
    return F.concat(F.lit("[FrameBase: "), base, F.lit("] Apikey: "), api, F.lit(", ApiVersion: "), version.cast("string"), F.lit(", ClientId: "), client, F.lit(", Msg: "), message)
