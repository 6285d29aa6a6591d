"""Views over the given tables that stand for network evidence.

Every view is written twice from the same templates: as a Spark DataFrame and
as a SQL common table expression, so both sides derive it on their own from the
parquet tables, over all rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators.carry import MOST


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Few short rows that become many each, on all partitions of the session: a small file is read by one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- configuration and show-output lines, one file per order ----------------
# placeholders: k order, p part, s supplier, q quantity, v VLAN, and small remainders
_VARIABLES = {
    "k": "l_orderkey", "p": "l_partkey", "s": "l_suppkey", "q": "cast(l_quantity as int)",
    "v": "l_partkey % 40 + 2", "v3": "l_partkey % 40 + 102", "port": "l_partkey % 24 + 1", "gig": "l_partkey % 4",
    "acl": "l_suppkey % 5", "num": "l_suppkey % 150 + 1", "h": "l_partkey % 250 + 1", "m": "l_suppkey % 4", "nat": "l_suppkey % 9 + 90",
    "r": "l_suppkey % 9 + 1", "x": "l_partkey % 3", "d": "l_suppkey % 10 + 1000",
    "host": "case when l_orderkey % 3 = 0 then 'R' when l_orderkey % 3 = 1 then 'SW' else 'core-' end",
    "web": "case when l_partkey % 2 = 0 then 'server' else 'secure-server' end",
    "via": "case when l_suppkey % 3 = 0 then 'telnet' when l_suppkey % 3 = 1 then 'ssh' else 'all' end",
    "down": "case when l_partkey % 11 = 0 then 'shutdown' else 'no shutdown' end",
    "end": "l_suppkey % 2 + 1",
}
_TEMPLATES = {
    1: [
        "hostname {host}{k}", "service password-encryption", "enable secret 5 x{k}zz",
        "username admin{r} privilege 15 secret pw{k}", "ip domain-name net{r}.example", "ip http {web}",
        "snmp-server community comm{m} RO", "logging host 10.{m}.0.{h}", "ntp server 10.0.0.{h}", "aaa new-model",
        "line vty 0 4", " transport input {via}", " login local", " exec-timeout 5 0", "radius-server host 10.1.1.{h} key abc{m}", "!",
    ],
    2: [
        "vlan {v}", " name USERS_{v}", "interface FastEthernet0/{port}", " description access port {p}",
        " switchport mode access", " switchport access vlan {v}", " switchport voice vlan {v3}", " switchport port-security",
        " switchport port-security maximum {r}", " switchport port-security violation restrict", " spanning-tree portfast",
        " storm-control broadcast level 5.00", " {down}", "end",
    ],
    3: [
        "interface GigabitEthernet0/{gig}", " switchport mode trunk", " switchport trunk allowed vlan 10,20-22,{v}",
        " switchport trunk native vlan {nat}", " channel-group {m} mode active", " duplex full", " mtu 9000",
        "SW{k}# show interfaces trunk", "Gi0/{gig}  on  802.1q  trunking  1", "Port  Vlans allowed on trunk", "Gi0/{gig}  10,20-22,{v}",
        "Port  Vlans allowed and active in management domain", "Gi0/{gig}  10,20",
        "Port  Vlans in spanning tree forwarding state and not pruned", "Gi0/{gig}  10",
    ],
    4: [
        "ip dhcp excluded-address 10.10.{v}.1 10.10.{v}.9", "ip dhcp pool POOL_{v}", " network 10.10.{v}.0 255.255.255.0",
        " default-router 10.10.{v}.{end}", " dns-server 8.8.8.8 1.1.1.1", " domain-name campus.example",
        "interface GigabitEthernet0/0.{v}", " encapsulation dot1Q {v}", " ip address 10.10.{v}.1 255.255.255.0",
        " ip access-group ACL_{acl} in", " ip nat inside", " standby {r} ip 10.10.{v}.254", " ip helper-address 10.0.0.5",
        "ip route 0.0.0.0 0.0.0.0 10.0.0.{h}", "ip nat inside source list 1 interface GigabitEthernet0/1 overload",
        "router ospf {r}", " network 10.10.0.0 0.0.255.255 area 0", " passive-interface default", " redistribute static",
    ],
    5: [
        "ip access-list extended ACL_{acl}", " 10 deny ip 10.10.{v}.0 0.0.0.255 10.10.0.0 0.0.255.255",
        " 20 permit tcp any host 10.0.0.{h} eq 443", " permit ip any any", "access-list {num} permit 10.10.{v}.0 0.0.0.255",
        "SW{k}# show access-lists", "Extended IP access list ACL_{acl}", "    10 deny ip any any ({x} matches)",
        "    20 permit ip any any ({q} matches)", "no ip domain-lookup",
    ],
    6: [
        "SW{k}# show cdp neighbors detail", "Device ID: N{r}", "Platform: cisco WS-C{p},  Capabilities: Switch IGMP",
        "Interface: GigabitEthernet0/{gig},  Port ID (outgoing port): FastEthernet0/{port}",
        "T{r}              Fas 0/{m}           153        S I         2960      Fas 0/{port}",
        "System Name: L{r}", "Local Intf: Gi0/{gig}", "Port id: Gi0/{m}", "System Description: build {p}",
        "Internet  10.10.{v}.{h}   5   00aa.bb{d}.00{port}   ARPA   Vlan{v}", "  {v}    00aa.bbcc.{d}    DYNAMIC     Fa0/{port}",
        "GigabitEthernet0/{gig}     10.10.{v}.{end}    YES manual up                    up",
        "Fa0/{port}   link{p}   connected    {v}   a-full  a-100 10/100BaseTX",
        "O    10.20.{v}.0/24 [110/{s}] via 10.0.0.{h}, 00:00:12, GigabitEthernet0/1",
        "10.255.0.{h}   1   FULL/DR   00:00:35   10.0.0.{r}   GigabitEthernet0/{gig}",
        "ssid CORP-{m} wpa2", "AP-0{m} joined the wlan radio{r}", "Internet access via the erp portal",
    ],
    0: [
        "GigabitEthernet0/{gig} is up, line protocol is up", "  {r} input queue drops, {m} total output drops", "     {x} input errors, {m} CRC, 0 frame",
        "     {m} output errors, 0 collisions", "VLAN00{nat}", "  Root ID    Priority    3276{m}", "             Address     00d0.97a1.{d}",
        "             Cost 19 Port {port}(FastEthernet0/{port})", "Fa0/{port}            Root FWD 19        128.1    P2p",
        "VLAN Name                             Status    Ports", "{v}   USERS_{v}   active    Fa0/1, Fa0/{port}",
        "{m}  Po{m}(SU)  LACP  Fa0/1(P) Fa0/{port}(P)", 'NAME: "chassis {m}", DESCR: "unit {p}"', "PID: WS-{p} , VID: V0{m}, SN: FOC{s}",
        "cisco WS-C{m} (PowerPC405) processor with 65536K bytes", "Cisco IOS Software, C2960 Version 15.{m}", "SW{k} uptime is {q} days",
        "Secure Port : Fa0/{port}", "Port Security : Enabled", "Maximum MAC Addresses : {r}", "Violation Mode : Shutdown",
        "Security Violation Count : {x}", "Last Source Address:Vlan : 0001.{d}.aaaa",
    ],
}
LINES_PER_ITEM = 32
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"


def _concat(template: str) -> str:
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(f"cast({_VARIABLES[piece[1:-1]]} as string)")
        elif piece:
            parts.append("'" + piece + "'")
    return "concat(" + ", ".join(parts) + ")"


def _line_arrays(open_: str, close: str) -> str:
    arms = [f"when {n} then {open_}{', '.join(_concat(t) for t in ts)}{close}" for n, ts in _TEMPLATES.items()]
    return "case l_linenumber % 7 " + " ".join(arms) + " end"


def _pieces(template: str) -> tuple[list[str], list[str]]:
    """Fixed texts of a template and the variables between them, both of the length that the longest template needs."""
    parts = re.split(r"\{(\w+)\}", template)
    texts, names = parts[::2], parts[1::2]
    return texts + [""] * (_SLOTS + 1 - len(texts)), names + [""] * (_SLOTS - len(names))


_SLOTS = max(len(re.findall(r"\{\w+\}", t)) for ts in _TEMPLATES.values() for t in ts)
_NAMES = ["", *_VARIABLES]


def _template_rows() -> str:
    """Templates by kind as one constant: rows of fixed texts and of places in the array of values."""
    def row(template: str) -> str:
        texts, names = _pieces(template)
        cells = [f"'{t}' as t{i}" for i, t in enumerate(texts)] + [f"{_NAMES.index(n)} as v{i}" for i, n in enumerate(names)]
        return "struct(" + ", ".join(cells) + ")"

    return "array(" + ", ".join("array(" + ", ".join(row(t) for t in _TEMPLATES[k]) + ")" for k in sorted(_TEMPLATES)) + ")"


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`file_id, line_no, text`: configuration and show output of one device per order.

    The values of an item are made once, its templates exploded from a constant, and a line is put together after that: one
    small expression for all templates, as an expression of them all is too long for the JVM to compile.
    """
    from pyspark.sql import Window

    item = Window.partitionBy("l_orderkey").orderBy(*[c.strip() for c in _ORDER.split(",")])
    # one item becomes about fifteen lines: keep the full number of partitions for the rows to come
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = table(spark, sf_dir, "lineitem").repartition(wide, "l_orderkey").withColumn("_seq", F.row_number().over(item))
    values = ", ".join(["''"] + [f"cast({_VARIABLES[n]} as string)" for n in _NAMES[1:]])
    items = numbered.select(F.col("l_orderkey").alias("file_id"), "_seq", (F.col("l_linenumber") % 7).cast("int").alias("_kind"), F.expr(f"array({values})").alias("_v"))
    rows = items.select("file_id", "_seq", "_v", F.posexplode(F.get(F.expr(_template_rows()), F.col("_kind"))).alias("_pos", "_t"))
    cells = [F.col("_t.t0")]
    for i in range(_SLOTS):
        cells += [F.col("_v")[F.col(f"_t.v{i}")], F.col(f"_t.t{i + 1}")]
    line_no = ((F.col("_seq") - 1) * LINES_PER_ITEM + F.col("_pos") + 1).cast("long")
    # exploded, the text is made once a line; as a plain column it would be made again for each pattern of a filter
    # an order has seven items at most: its lines need no chunks (a longer one is still right, as one file in one task)
    most = {MOST: 7 * LINES_PER_ITEM}
    return rows.select("file_id", line_no.alias("line_no", metadata=most), F.explode(F.array(F.concat(*cells))).alias("text"))


CONFIG_LINES_SQL = f"""
_items as (
  select *, row_number() over (partition by l_orderkey order by {_ORDER}) as _seq from lineitem),
_arrays as (select l_orderkey as file_id, _seq, {_line_arrays('[', ']')} as _a from _items),
_exploded as (select file_id, _seq, unnest(_a) as text, generate_subscripts(_a, 1) as _pos from _arrays),
config_lines as (
  select file_id, cast((_seq - 1) * {LINES_PER_ITEM} + _pos as bigint) as line_no, text from _exploded)"""

# --- wireless views ---------------------------------------------------------
_ROLE = "case c_nationkey % 3 when 0 then 'Staff' when 1 then 'Student' else 'Guest' end"
_SHOWN_ROLE = "case when c_custkey % 17 = 0 then 'Guest' else " + _ROLE + " end"
CLIENT_COLUMNS = {
    "name": "c_name",
    "role": _SHOWN_ROLE,
    "ssid": f"case when c_custkey % 19 = 0 then null else concat({_ROLE}, 'WiFi') end",
    "vlan": "case when c_custkey % 11 = 0 then '99' else cast((c_nationkey % 3 + 1) * 10 as string) end",
    "ip": "case when c_custkey % 23 = 0 then '' when c_custkey % 13 = 0 then concat('10.10.99.', cast(c_custkey % 250 + 2 as string))"
          " else concat('10.10.', cast((c_nationkey % 3 + 1) * 10 as string), '.', cast(c_custkey % 250 + 2 as string)) end",
    "ap": "concat('AP-', cast(c_custkey % 120 as string))",
    "status": "case when c_acctbal < 0 then 'disassociated' else 'associated' end",
    "services_text": "case when c_custkey % 7 = 0 then 'Internet,ERP' else 'Internet,DNS' end",
}
AP_COLUMNS = {
    "name": "concat('AP-', cast(s_suppkey as string))",
    "switch": "concat('SW', cast(s_nationkey as string))",
    "uplink_interface": "concat('GigabitEthernet0/', cast(s_suppkey % 48 as string))",
    "max_clients": "s_nationkey % 20 + 5",
    "supported_text": "case s_nationkey % 4 when 0 then '10,20,30' when 1 then '10' when 2 then '20,30' else '30' end",
}
EVENT_COLUMNS = {
    "id": "event_id",
    "ts": "ts",
    "type": "case event_type when 'click' then 'association' when 'view' then 'roaming' when 'error' then 'authentication_failure'"
            " when 'signup' then 'dhcp_assignment' else 'policy_violation' end",
    "client": "concat('Customer#', lpad(cast(user_id as string), 9, '0'))",
    "k": "cast(regexp_extract(props, '([0-9]+)', 1) as int)",
}


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr(*[f"{e} as {n}" for n, e in CLIENT_COLUMNS.items()])
    return df.withColumn("services", F.split("services_text", ",")).drop("services_text")


def aps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").selectExpr(*[f"{e} as {n}" for n, e in AP_COLUMNS.items()])
    return df.withColumn("supported_vlans", F.split("supported_text", ",")).drop("supported_text")


def wireless_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_events(table(spark, sf_dir, "events").selectExpr(*[f"{e} as {n}" for n, e in EVENT_COLUMNS.items()]))


def shape_events(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "ts", "type", "client",
        F.when(F.col("type") == "roaming", F.concat(F.lit("AP-"), (F.col("k") % 100).cast("string"))).alias("to_ap"),
        F.when(F.col("type") == "association", F.concat(F.lit("AP-"), (F.col("k") % 100).cast("string"))).alias("ap"),
        F.when((F.col("type") == "association") & (F.col("k") % 3 > 0),
               F.when(F.col("k") % 3 == 1, "StaffWiFi").otherwise("GuestWiFi")).alias("ssid"),
        F.when((F.col("type") == "dhcp_assignment") & (F.col("k") % 2 == 0),
               F.concat(F.lit("10.10."), ((F.col("k") % 3 + 1) * 10).cast("string"), F.lit("."), (F.col("k") + 10).cast("string"))).alias("ip"),
        F.when((F.col("type") == "dhcp_assignment") & (F.col("k") % 5 == 0), ((F.col("k") % 3 + 1) * 10).cast("string")).alias("vlan"),
    )


def ssids(spark: SparkSession) -> DataFrame:
    """The three policy rows; the dimension is fixed by the policy, not by the data."""
    return spark.sql(f"select * from values {_ssid_values('array(', ')')} as t({_SSID_COLUMNS})")


_SSID_COLUMNS = "position, ssid, role, expected_vlan, expected_subnet, internet, internal_access, allowed_services"


def _ssid_values(open_: str = "[", close: str = "]") -> str:
    rows = []
    for i, (ssid, role, vlan, net, internet, access, services) in enumerate(fv.SSID_ROWS):
        names = ", ".join(f"'{s}'" for s in services)
        rows.append(f"({i}, '{ssid}', '{role}', '{vlan}', '{net}', {str(internet).lower()}, '{access}', {open_}{names}{close})")
    return ", ".join(rows)


WIRELESS_SQL = f"""
clients as (
  select {', '.join(f'{e} as {n}' for n, e in CLIENT_COLUMNS.items())} from customer),
aps as (select {', '.join(f'{e} as {n}' for n, e in AP_COLUMNS.items())} from supplier),
ssids({_SSID_COLUMNS}) as (values {_ssid_values()}),
_ev as (select {', '.join(f'{e} as {n}' for n, e in EVENT_COLUMNS.items())} from events),
wevents as (
  select id, ts, type, client,
    case when type = 'roaming' then concat('AP-', k % 100) end as to_ap,
    case when type = 'association' then concat('AP-', k % 100) end as ap,
    case when type = 'association' and k % 3 = 1 then 'StaffWiFi' when type = 'association' and k % 3 = 2 then 'GuestWiFi' end as ssid,
    case when type = 'dhcp_assignment' and k % 2 = 0 then concat('10.10.', (k % 3 + 1) * 10, '.', k + 10) end as ip,
    case when type = 'dhcp_assignment' and k % 5 = 0 then cast((k % 3 + 1) * 10 as varchar) end as vlan
  from _ev)"""

# --- text lines and graph edges ---------------------------------------------
TEXT_LINES_SQL = """
_split as (select doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) as _a from documents),
text_lines as (
  select doc_id as file_id, unnest(_a) as text, cast(generate_subscripts(_a, 1) as bigint) as line_no from _split)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import lines_of_texts

    return lines_of_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("line_no", F.col("line_no").cast("long"))
