"""DuckDB SQL for the results of those queries that SQL can state."""

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc32(text: str) -> str:
    """The CRC-32 of a text's UTF-8 bytes, byte by byte; the table of 256 remainders is built by its rule."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, x: xor(a >> 8, ({table}::bigint[])[(xor(a, x) & 255) + 1])), 4294967295)"


def sharding(n_shards: int) -> str:
    return f"""
    with d as (select doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 16 as size from documents),
    p as (select *, md5(text) as m, (sum(size) over (order by md5(text), doc_id rows between unbounded preceding and current row))::bigint - size as before, (sum(size) over ())::bigint as total from d),
    s as (select *, least({n_shards - 1}, (2 * before + size) * {n_shards} // (2 * total))::int as shard from p)
    select doc_id, size, {crc32('text')} as text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by m, doc_id) - 1 as slot, null::int as grown_shard from s"""


def decontamination(window: int = 13) -> str:
    ws = f"regexp_extract_all({_LOWER.format('coalesce(text, ' + repr('') + ')')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    with b as (select cast(item_id as varchar) as item, {ws} as ws from benchmark),
    w as (select distinct item, array_to_string(ws[i:i + {window} - 1], ' ') as t, least(len(ws), {window}) as n from (select *, unnest(range(1, greatest(len(ws) - {window} + 1, 1) + 1)) as i from b where len(ws) > 0)),
    d as (select doc_id, {ws} as ws from documents),
    lengths as (select distinct n from w),
    g as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as t from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, lengths where len(ws) >= n)),
    m as (select g.doc_id, g.i, g.n, w.item from g join w on g.t = w.t and g.n = w.n),
    hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from m) group by 1),
    it as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from m group by 1)
    select d.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from d left join hit using (doc_id) left join it using (doc_id)"""


def warc(least: int = 1000) -> str:
    return f"""
    with p as (select page_id, coalesce(html, '') as h from pages),
    l as (select h, max(page_id) as last from p where strlen(h) >= {least} group by 1)
    select page_id, strlen(p.h) as payload_bytes, sha1(p.h) as payload_digest, case when last is not null and last <> page_id then 'revisit' else 'response' end as record_type, case when last <> page_id then last end as refers_to
    from p left join l on p.h = l.h"""


def jaccard(width: int = 4, percent: int = 85) -> str:
    ws = f"regexp_extract_all({_LOWER.format('coalesce(text, ' + repr('') + ')')}, '[^\\x20\\x09-\\x0D]+')"
    return f"""
    with recursive d as (select doc_id, {ws} as ws from documents),
    s as (select distinct doc_id, array_to_string(ws[i:i + {width} - 1], ' ') as t from (select *, unnest(range(1, greatest(len(ws) - {width} + 1, 1) + 1)) as i from d where len(ws) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
    e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {percent} * (x.n + y.n - c)),
    u as (select a, b from e union all select b, a from e),
    r as (select doc_id as a, doc_id as b from d union select r.a, u.b from r join u on r.b = u.a),
    f as (select a, count(*) as f from u group by 1)
    select r.a as doc_id, coalesce(max(n), 0) as n_shingles, min(r.b) as component_id, coalesce(max(f), 0) as n_links from r left join n on n.doc_id = r.a left join f on f.a = r.a group by 1"""


def quality() -> str:
    from .quality import MAX_REPEAT_PERCENT, MEASURES, MIN_WORDS, SUPPORT

    sketched = [*MEASURES, *sorted({m[1] for m in MEASURES.values()})]
    value = {m: f"1000 * {c} // greatest({of}, 1)" for m, (c, of, *_) in MEASURES.items()}
    long = " union all ".join(f"select lang, source, '{m}' as m, {'m_' + m if m in MEASURES else m} as v from b where not base_failed" for m in sketched)
    permille = lambda k: "case m " + " ".join(f"when '{m}' then {p[k]}" for m, p in MEASURES.items()) + " else 500 end"
    fences = []
    for m, (_, of, _, _, fence, least) in MEASURES.items():
        slack = f"{m}.mid // 8" if least is None else f"{1000 * least} // greatest({of}.mid, 1)"
        spread = f"greatest({fence} * ({m}.top - {m}.bottom), {slack})"
        fences.append(f"{m}.top + {spread} as hi_{m}, {m}.bottom - {spread} as lo_{m}")
    bad = " or ".join(f"m_{m} > hi_{m}" + (f" or m_{m} < lo_{m}" if MEASURES[m][-1] is None else "") for m in MEASURES)
    level = lambda keys: f"""select {', '.join([*keys, 'm'])}, max(t) as t, struct_pack(top := min(case when 1000 * c >= ({permille(2)}) * t then k end), bottom := min(case when 1000 * c >= ({permille(3)}) * t then k end), mid := min(case when 1000 * c >= 500 * t then k end)) as q
        from (select *, sum(n) over (partition by {', '.join([*keys, 'm'])} order by k) as c, sum(n) over (partition by {', '.join([*keys, 'm'])}) as t from (select {', '.join([*keys, 'm'])}, k, count(*) as n from x group by all)) group by {', '.join([*keys, 'm'])}"""  # noqa: E731
    enough = lambda t: f"{t}.t * (1000 - ({permille(2).replace('case m', f'case {t}.m')})) >= {SUPPORT * 1000}"
    return f"""
    with d as (select doc_id, lang, source, coalesce(text, '') as text, {_SPACED} as ws from documents),
    g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) > 2)),
    again as (select doc_id, count(distinct p) as r from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, t) as c from g) where c > 1) group by 1),
    ls as (select doc_id, count(*) as n, count(*) - count(distinct l) as dup from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
    a as (select d.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols, coalesce(dup, 0) as n_dup_lines, coalesce(n, 0) as n_lines, coalesce(r, 0) as n_repeat_words from d left join again using (doc_id) left join ls using (doc_id)),
    b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed, {', '.join(f'{v} as m_{m}' for m, v in value.items())} from a),
    x as (select lang, source, m, case when v < 256 then v else (v >> (len(bin(v)) - 8)) << (len(bin(v)) - 8) end as k from ({long})),
    q0 as ({level(['lang', 'source'])}),
    q1 as ({level(['lang'])}),
    q2 as ({level([])}),
    q as (select q0.lang, q0.source, q0.m, case when {enough('q0')} then q0.q when {enough('q1')} then q1.q else q2.q end as q from q0 join q1 on q0.lang is not distinct from q1.lang and q0.m = q1.m join q2 on q0.m = q2.m),
    w as (select lang, source, {', '.join(f"any_value(q) filter (m = '{m}') as {m}" for m in sketched)} from q group by 1, 2),
    f as (select lang, source, {', '.join(fences)} from w)
    select b.doc_id, b.n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce({bad}, false) as kept
    from b left join f on b.lang is not distinct from f.lang and b.source is not distinct from f.source"""


def mixing(seed: str = "mix") -> str:
    from .mixing import BLOCK, GOLDEN, MIX_PERCENT, MOST_REPEATS, POINTS, WEIGHTS

    return f"""
    with d as (select doc_id, source, cast(len({_SPACED}) as bigint) as size from documents),
    s as (select source, sum(size)::bigint as source_size from d group by 1),
    w as (select *, ([{', '.join(map(str, WEIGHTS))}])[(row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1] as weight, {MOST_REPEATS} * source_size as cap, (sum(source_size) over ())::bigint * {MIX_PERCENT / 100}::double as budget from s),
    l as (select *, cap / weight as level_of, row_number() over (order by cap / weight, source nulls last) as k, (budget - coalesce((sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding))::bigint, 0)) / ((sum(weight) over ())::bigint - coalesce((sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding))::bigint, 0)) as level from w),
    t as (select source, source_size, coalesce(least(cap::double, (select arg_min(level, k) from l where level * weight < cap) * weight), cap::double) as target from l),
    p as (select d.*, sum(size) over (partition by source order by md5('{seed}' || doc_id), size rows between unbounded preceding and current row) - size as start from d),
    b as (select source, source_size, round(target)::bigint as words, (source_size + {BLOCK - 1}) // {BLOCK} as blocks from t where source_size > 0),
    c as (select *, (words // source_size * blocks + (words % source_size + {BLOCK - 1}) // {BLOCK})::bigint as slots from b),
    e as (select *, (sum(slots) over (order by source nulls last))::bigint as upto, (sum(slots) over ())::bigint as n from c),
    f as (select *, floor((upto - slots) / n * {POINTS}.0::double)::bigint as lo, floor(upto / n * {POINTS}.0::double)::bigint as hi from e),
    i as (select i, i % {POINTS} * {GOLDEN} % {POINTS} as u from (select unnest(range((select max(n) from e))) as i)),
    r as (select source, i as slot, row_number() over (partition by source order by i) - 1 as rank from i join f on lo <= u and u < hi),
    r2 as (select * from r union all select source, n + rank as slot, rank from (select f.source, f.n, unnest(range(coalesce(g, 0), f.slots)) as rank from f left join (select source, count(*) as g from r group by 1) h on f.source is not distinct from h.source)),
    x as (select f.source, slot, rank % blocks * {BLOCK} as lo, least((rank % blocks + 1) * {BLOCK}, source_size, words - rank // blocks * source_size) as hi from r2 join f on f.source is not distinct from r2.source where rank < slots),
    y as (select p.doc_id, p.start, sum(greatest(0, least(hi, start + size) - greatest(lo, start))) as taken, min(slot) as first_slot, max(slot) as last_slot from p join x on p.source is not distinct from x.source and start < hi and lo < start + size group by 1, 2)
    select p.doc_id, p.size, source_size, target, coalesce(taken, 0)::bigint as taken, first_slot, last_slot
    from p join t on p.source is not distinct from t.source left join y on p.doc_id = y.doc_id and p.start = y.start and p.size > 0"""
