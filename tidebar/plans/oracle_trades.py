"""SQL statements that state what the outcome, ledger, risk, evaluation, journal, news and log
queries must return. Used for checking only."""

from __future__ import annotations

from tidebar.functions.params import AVOID_WORDS, CAUTION_WORDS
from tidebar.plans.oracle_series import (
    DIST,
    HYBRID,
    KEY,
    REGIME,
    REGIME_FLAGS,
    VOTES,
    W,
    bars,
    barrier,
    ema,
    ind,
    r,
    roll,
    span,
)

HEAD = f"WITH RECURSIVE {bars()}, {ind()}, {VOTES.replace('SRC', 'ind')}"
SIG = """sig AS MATERIALIZED (SELECT symbol, ts, pos, open, high, low, close, volume, atr, tech_confidence AS confidence,
  CASE tech_signal WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 ELSE 0 END AS signal,
  CASE tech_signal WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN -1 END AS direction FROM votes)"""


def outcomes(levels: str, width: str) -> str:
    tp, sl = levels.split("|")
    hit = "CASE WHEN direction = 1 THEN {0}.h >= tp ELSE {0}.l <= tp END"
    los = "CASE WHEN direction = 1 THEN {0}.l <= sl ELSE {0}.h >= sl END"
    return f"""{SIG},
oa AS (SELECT *, list({{'b': pos, 'h': high, 'l': low, 'c': close}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 48 FOLLOWING) AS nxt,
  {width} AS wid, close * (1 + CAST(0.0002 AS DOUBLE) * direction) AS entry_price FROM sig),
ob AS (SELECT *, {tp} AS tp, {sl} AS sl FROM oa WHERE direction IS NOT NULL AND confidence >= 0.6 AND len(nxt) > 0),
oc AS (SELECT *, list_filter(nxt, lambda b: {hit.format('b')} OR {los.format('b')})[1] AS hit, nxt[-1] AS lst,
  CAST(1000 AS DOUBLE) / greatest(wid / close, 0.001) / entry_price AS quantity FROM ob),
od AS (SELECT *, CASE WHEN hit IS NOT NULL AND {hit.format('hit')} THEN 'TP' WHEN hit IS NOT NULL THEN 'SL' WHEN len(nxt) < 48 THEN 'END' ELSE 'MAX_BARS' END AS exit_reason,
  coalesce(hit.b, lst.b) AS exit_bar, CASE WHEN hit IS NOT NULL AND {hit.format('hit')} THEN tp WHEN hit IS NOT NULL THEN sl ELSE lst.c END AS rawx FROM oc),
oe AS (SELECT *, pos AS entry_bar, rawx * (1 - CAST(0.0002 AS DOUBLE) * direction) AS exit_price FROM od),
ox AS MATERIALIZED (SELECT *, direction * (exit_price - entry_price) * quantity AS pnl_gross, (entry_price + exit_price) * quantity * 0.0004 AS fee_paid,
  (abs(rawx - exit_price) + abs(entry_price * 0.0002)) * quantity AS slippage_cost,
  direction * (exit_price - entry_price) * quantity - (entry_price + exit_price) * quantity * 0.0004 AS pnl_net FROM oe)"""


ATR = outcomes("entry_price + direction * 2 * wid|entry_price - direction * wid", "coalesce(atr, close * 0.01)")
PCT = outcomes("entry_price * (1 + direction * 0.5)|entry_price * (1 - direction * 0.25)", "close * 0.25")

CLOSE = f"""{SIG},
ca AS (SELECT *, list({{'b': pos, 'c': close}}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 32 FOLLOWING) AS nxt, close * (1 + CAST(0.0002 AS DOUBLE) * direction) AS entry_price FROM sig),
cb AS (SELECT *, list_filter(nxt, lambda b: direction * (b.c - entry_price) / entry_price >= 0.6 OR direction * (b.c - entry_price) / entry_price <= -0.3 OR b.b - pos >= 32)[1] AS hit
  FROM ca WHERE direction IS NOT NULL AND confidence >= 0.42),
cc AS (SELECT *, pos AS entry_bar, hit.b AS exit_bar, direction * (hit.c - entry_price) / entry_price AS mv, hit.c * (1 - CAST(0.0002 AS DOUBLE) * direction) AS exit_price FROM cb),
ox AS MATERIALIZED (SELECT *, greatest(-1, least(2, (direction * (exit_price - entry_price) / entry_price - CAST(0.0008 AS DOUBLE)) / 0.3)) AS r_mult,
  100 * greatest(-1, least(2, (direction * (exit_price - entry_price) / entry_price - CAST(0.0008 AS DOUBLE)) / 0.3)) AS pnl_net,
  CASE WHEN mv >= 0.6 THEN 'TP' WHEN mv <= -0.3 THEN 'SL' ELSE 'TIMEOUT' END AS exit_reason FROM cc)"""


def fold_rows(src: str, tp: str, sl: str, keys: str = "symbol") -> str:
    mv = "direction * ({0}.c - entry_price) / entry_price"
    return f"""fa AS (SELECT *, list({{'b': pos, 'c': close, 's': signal}}) OVER (PARTITION BY {keys} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nxt0,
  max(pos) OVER (PARTITION BY {keys}) AS endpos, close * (1 + CAST(0.0002 AS DOUBLE) * direction) AS entry_price FROM {src}),
fb AS (SELECT *, list_filter(nxt0, lambda b: b.b < endpos AND ({mv.format('b')} >= {tp} OR {mv.format('b')} <= -{sl} OR b.b - pos >= 10 OR b.s = 0
   OR (direction = 1 AND b.s = 2) OR (direction = -1 AND b.s = 1)))[1] AS hit FROM fa WHERE direction IS NOT NULL),
fc AS (SELECT *, {mv.format('hit')} AS mv FROM fb),
ox AS MATERIALIZED (SELECT *, pos AS entry_bar, hit.b AS exit_bar, CASE WHEN mv >= {tp} THEN {tp} WHEN mv <= -{sl} THEN -{sl} ELSE mv END - CAST(0.001 AS DOUBLE) AS net_return,
  CASE WHEN mv < {tp} AND mv > -{sl} AND hit.b - pos < 10 AND hit.s <> 0 THEN hit.b ELSE hit.b + 1 END AS free_from FROM fc)"""


def kept(free: str, keys: tuple[str, ...] = ("symbol",)) -> str:
    """Greedy chain: the next kept candidate is the first one at or after the free bar. One without
    an exit has no such bar, ends the chain and is no trade."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    return f"""oy AS (SELECT *, {free} AS fr FROM ox),
oz AS MATERIALIZED (SELECT a.*, b.entry_bar AS nx FROM oy a ASOF LEFT JOIN (SELECT {k}, entry_bar FROM ox) b ON {on} AND a.fr <= b.entry_bar),
chain AS (SELECT {k}, min(entry_bar) AS entry_bar FROM oz GROUP BY {k}
  UNION ALL SELECT {', '.join('a.' + x for x in keys)}, a.nx FROM chain b JOIN oz a ON {on} AND a.entry_bar = b.entry_bar WHERE a.nx IS NOT NULL),
led AS MATERIALIZED (SELECT oz.* FROM oz JOIN chain USING ({k}, entry_bar) WHERE exit_bar IS NOT NULL)"""


LED = f"{HEAD}, {ATR}, {kept('exit_bar')}"
EQ = f"""{LED},
real AS (SELECT symbol, exit_bar AS pos, sum(pnl_net) AS p FROM led GROUP BY 1, 2),
ea AS (SELECT n.symbol, n.pos, n.close, sum(coalesce(p, 0)) OVER (PARTITION BY n.symbol ORDER BY n.pos) AS rp FROM n LEFT JOIN real ON n.symbol = real.symbol AND n.pos = real.pos),
eq AS MATERIALIZED (SELECT ea.symbol, ea.pos AS bar_ix, 10000 + rp + CASE WHEN ea.pos < l.exit_bar THEN l.direction * (ea.close - l.entry_price) * l.quantity ELSE 0 END AS equity
  FROM ea ASOF LEFT JOIN led l ON ea.symbol = l.symbol AND ea.pos >= l.entry_bar),
dd AS MATERIALIZED (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY bar_ix) AS peak, (equity - lag(equity) OVER (PARTITION BY symbol ORDER BY bar_ix)) / (lag(equity) OVER (PARTITION BY symbol ORDER BY bar_ix) + 1e-10) AS ret FROM eq),
dx2 AS MATERIALIZED (SELECT *, (equity - peak) / (peak + 1e-10) AS drawdown FROM dd)"""

RF = "(pow(CAST(1.05 AS DOUBLE), CAST(1 AS DOUBLE) / 35040) - 1)"
TM = """count(*) AS n_trades, count(*) FILTER (WHERE pnl_net > 0) AS n_wins, count(*) FILTER (WHERE pnl_net < 0) AS n_losses,
 coalesce(avg(pnl_net) FILTER (WHERE pnl_net > 0), 0) AS avg_win, coalesce(avg(pnl_net) FILTER (WHERE pnl_net < 0), 0) AS avg_loss,
 coalesce(max(pnl_net) FILTER (WHERE pnl_net > 0), 0) AS largest_win, coalesce(min(pnl_net) FILTER (WHERE pnl_net < 0), 0) AS largest_loss, avg(pnl_net) AS avg_trade_pnl,
 least(99, coalesce(sum(pnl_net) FILTER (WHERE pnl_net > 0), 0) / (coalesce(-sum(pnl_net) FILTER (WHERE pnl_net < 0), 1e-10) + 1e-10)) AS profit_factor,
 sum(fee_paid) AS total_fees_paid, count(*) FILTER (WHERE direction = 1) AS n_longs, count(*) FILTER (WHERE direction = -1) AS n_shorts,
 avg(exit_bar - entry_bar) AS avg_hold_bars, min(exit_bar - entry_bar) AS min_hold_bars, max(exit_bar - entry_bar) AS max_hold_bars, 100.0 * count(*) FILTER (WHERE pnl_net > 0) / count(*) AS win_rate_pct"""

JOURNAL = """j AS MATERIALIZED (SELECT o_orderpriority AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, o_orderdate AS ts, o_orderkey AS trade_id,
  o_totalprice > 180000 AS won, round(o_totalprice - 180000, 2) AS pnl, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS exit_bar,
  CASE o_orderstatus WHEN 'F' THEN 'TRENDING' WHEN 'O' THEN 'RANGE' ELSE 'HIGH_VOLATILITY' END AS regime FROM orders)"""
ROLL20 = """k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY ts, trade_id) AS rn, avg(CASE WHEN won THEN 1.0 ELSE 0.0 END) OVER w AS wr, count(*) OVER w AS n_recent FROM j
  WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, trade_id ROWS 19 PRECEDING)),
ka AS (SELECT *, CASE WHEN n_recent < 6 THEN 0 WHEN wr < 0.35 THEN 4 WHEN wr > 0.6 THEN -2 ELSE 4 - 6 * ((wr - 0.35) / 0.25) END::DOUBLE AS adj FROM k)"""
STREAK = """sa AS (SELECT *, row_number() OVER w AS rn, CASE WHEN won THEN row_number() OVER w END AS wp, CASE WHEN NOT won THEN row_number() OVER w END AS lp FROM j WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, trade_id)),
sb AS MATERIALIZED (SELECT *, CASE WHEN won THEN rn - coalesce(max(lp) OVER v, 0) ELSE -(rn - coalesce(max(wp) OVER v, 0)) END AS streak FROM sa WINDOW v AS (PARTITION BY symbol, side ORDER BY rn))"""
KELLY = """ke AS (SELECT *, count(*) OVER w AS kn, count(*) FILTER (WHERE pnl > 0) OVER w AS kw, avg(pnl) FILTER (WHERE pnl > 0) OVER w AS aw, avg(pnl) FILTER (WHERE pnl < 0) OVER w AS al FROM j
  WINDOW w AS (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
kel AS MATERIALIZED (SELECT *, CASE WHEN kn >= 10 AND aw IS NOT NULL AND al IS NOT NULL THEN kw * 1.0 / kn ELSE 0.5 END::DOUBLE AS win_rate, CASE WHEN kn >= 10 AND aw IS NOT NULL AND al IS NOT NULL THEN aw ELSE 100 END::DOUBLE AS avg_win,
  CASE WHEN kn >= 10 AND aw IS NOT NULL AND al IS NOT NULL THEN abs(al) ELSE 80 END::DOUBLE AS avg_loss FROM ke)"""


def sizing(method: str) -> str:
    frac = {
        "fixed_fractional": "0.015",
        "kelly": "kf * greatest(0.3, least(1, conf / 0.65))",
        "half_kelly": "kf * 0.5 * greatest(0.3, least(1, conf / 0.65))",
        "vol_scaled": "CASE WHEN atr0 > 0 THEN CAST(0.015 AS DOUBLE) * (1 / greatest(0.5, atr0 / entry / 0.005)) ELSE 0.015 END",
    }[method]
    return f"""WITH {JOURNAL}, {KELLY},
za AS (SELECT *, abs(pnl) / 100 + 1 AS entry, (abs(pnl) / 100 + 1) * CAST(0.98 AS DOUBLE) AS stp, abs(pnl) / 10000 AS atr0, CAST(0.4 AS DOUBLE) + (trade_id % 50) / CAST(100 AS DOUBLE) AS conf,
  avg_win / (avg_loss + 1e-10) AS b, least(0.99, greatest(0.01, win_rate)) AS p FROM kel),
zb AS (SELECT *, CASE WHEN avg_loss <= 0 OR win_rate <= 0 OR win_rate >= 1 THEN 0.01 ELSE least(0.25, greatest(0, (p * b - (1 - p)) / (b + 1e-10))) END::DOUBLE AS kf, greatest(abs(entry - stp) / entry, 0.001) AS sd FROM za),
zc AS (SELECT *, least(10000 * greatest(least(CAST({frac} AS DOUBLE), 0.015), 0.001) / (sd * entry), 10000 * CAST(0.25 AS DOUBLE) / entry) AS q0 FROM zb),
zd AS (SELECT *, floor(q0 / CAST(0.001 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS q FROM zc)
SELECT trade_id, q > 0 AS approved, CASE WHEN q <= 0 THEN 'quantity rounds to 0' END AS reject_reason, round(CASE WHEN q > 0 THEN q ELSE 0 END, 3) + 0.0 AS quantity,
  round(CASE WHEN q > 0 THEN q * entry * sd ELSE 0 END, 3) + 0.0 AS risk_usdt, round(CASE WHEN q > 0 THEN kf ELSE 0 END, 5) + 0.0 AS kelly_fraction FROM zd"""


SIZED = f"""{HEAD}, va2 AS (SELECT 1), {REGIME},
rq AS (SELECT v.symbol, v.ts, v.pos, v.close AS e, v.atr, CASE v.tech_signal WHEN 'LONG' THEN 'long' ELSE 'short' END AS side, CASE v.tech_signal WHEN 'LONG' THEN 1 ELSE -1 END AS sg,
  1000 + 100 * (v.pos % 40) AS bal, v.pos % 6 AS open_trades, CASE regime WHEN 'TRENDING' THEN 2.5 WHEN 'RANGE' THEN 2.0 ELSE 2.8 END::DOUBLE AS slm,
  CASE regime WHEN 'TRENDING' THEN 3 * 1.2 WHEN 'RANGE' THEN 3.0 ELSE 3 * 1.1 END::DOUBLE AS tpm, CASE regime WHEN 'TRENDING' THEN 0.8 WHEN 'RANGE' THEN 1.0 ELSE 0.5 END::DOUBLE AS sz
  FROM votes v JOIN reg USING (symbol, pos) WHERE v.tech_signal <> 'HOLD'),
r1 AS (SELECT *, bal * (CAST(5 AS DOUBLE) / 100) * sz AS risk, CASE WHEN atr > 0 THEN atr * slm END AS sla, CASE WHEN atr > 0 THEN atr * tpm END AS tpa FROM rq),
r2 AS (SELECT *, risk * 10 / e AS qr FROM r1),
r3 AS (SELECT *, CASE WHEN floor(qr * 1000) / 1000 > 0 THEN floor(qr * 1000) / 1000 ELSE ceil(qr * 1000) / 1000 END AS q0, ceil(100 / e / CAST(0.001 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS mq,
  CAST(round(CAST(CAST(e + sg * coalesce(tpa, e * 0.015) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS tp, CAST(round(CAST(CAST(e - sg * coalesce(sla, e * 0.01) AS VARCHAR) AS DECIMAL(38, 18)), 4) AS DOUBLE) AS sl FROM r2),
r4 AS (SELECT *, q0 * e < 100 AS small, abs(e - sl) AS dist, CASE WHEN q0 * e < 100 THEN mq ELSE q0 END AS q1 FROM r3),
r5 AS (SELECT *, q1 * dist > risk AS ov, floor((risk / dist) / CAST(0.001 AS DOUBLE)) * CAST(0.001 AS DOUBLE) AS cq FROM r4),
r6 AS MATERIALIZED (SELECT *, CASE WHEN open_trades >= 5 THEN 'max open trades' WHEN bal <= 0 THEN 'no available balance' WHEN q0 <= 0 THEN 'quantity is 0'
  WHEN small AND mq * coalesce(sla, e * 0.02) > bal * 0.05 THEN 'minimum notional too risky' WHEN (side = 'long' AND tp <= e) OR (side = 'short' AND tp >= e) THEN 'take profit on wrong side'
  WHEN dist < e * 0.0005 THEN 'stop too tight' WHEN risk <= 0 THEN 'risk cap is 0' WHEN ov AND cq <= 0 THEN 'risk cap too small' WHEN ov AND cq * e < 100 THEN 'risk cap below minimum notional'
  WHEN abs(e - tp) / dist < 1 THEN 'reward below risk' END AS why, CASE WHEN ov THEN cq ELSE q1 END AS qty FROM r5)"""
# the same requests with their own leverage and risk, daily losses, open and blocked directions
GATED = (
    SIZED.replace("bal * (CAST(5 AS DOUBLE) / 100) * sz AS risk",
                  "bal * (CAST(CASE WHEN pos % 4 = 0 THEN 3 ELSE 5 END AS DOUBLE) / 100) * sz AS risk, "
                  "CASE WHEN pos % 3 = 0 THEN 20 ELSE 10 END AS lever, "
                  "least(bal * (CAST(CASE WHEN pos % 4 = 0 THEN 3 ELSE 5 END AS DOUBLE) / 100) * sz, "
                  "greatest(0, 48 - pos % 70)) AS cap")
    .replace("risk * 10 / e AS qr", "risk * lever / e AS qr")
    .replace("q1 * dist > risk AS ov, floor((risk / dist)", "q1 * dist > cap AS ov, floor((cap / dist)")
    .replace("WHEN risk <= 0", "WHEN cap <= 0")
    .replace("WHEN q0 <= 0", "WHEN (pos % 70) / 10.0 >= 5 OR pos % 70 >= 48 THEN 'daily loss limit' "
             "WHEN pos % 11 = 0 THEN 'direction blocked' WHEN pos % 7 = 0 THEN 'direction full' WHEN q0 <= 0")
)


POS = """pe AS (SELECT user_id, arg_min(value, event_id) AS entry_price, CAST(count(*) AS DOUBLE) AS quantity, CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END AS side, CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS sg,
  'USR' || user_id || 'USDT' AS symbol, arg_max(value, event_id) AS price FROM events WHERE value > 0 GROUP BY user_id)"""

PRED = f"""{HEAD}, {barrier(8, '1.5')},
pred AS MATERIALIZED (SELECT l.symbol, l.ts, l.pos, l.close, l.label AS y_true, CASE v.tech_signal WHEN 'LONG' THEN 1 WHEN 'SHORT' THEN 2 ELSE 0 END AS y_pred, greatest(v.tech_long, v.tech_short) AS confidence
  FROM lab l JOIN votes v USING (symbol, pos))"""
FOLDS = """cnt AS (SELECT symbol, count(*) AS nn, greatest(50, (count(*) - 60 - 24) // 3) AS sz FROM {0} GROUP BY 1),
fo AS (SELECT symbol, i, nn - (i + 1) * sz AS t0, nn - i * sz AS t1, nn - (i + 1) * sz - 8 AS te, count(*) OVER (PARTITION BY symbol) AS nf FROM cnt, (SELECT unnest([0, 1, 2]) AS i) WHERE nn - (i + 1) * sz - 8 >= 60),
mem AS (SELECT p.*, fo.nf - i AS fold, CASE WHEN pos < te THEN 'train' WHEN pos >= t0 AND pos < t1 THEN 'test' END AS role FROM {0} p JOIN fo USING (symbol))"""


def prf(k: int, n: str) -> str:
    tp, fp, fn = (f"count(*) FILTER (WHERE y_pred {a} {k} AND y_true {b} {k})" for a, b in (("=", "="), ("=", "<>"), ("<>", "=")))
    return f"{tp} / ({tp} + {fp} + 1e-10) AS precision_{n}, {tp} / ({tp} + {fn} + 1e-10) AS recall_{n}"


def f1k(k: int) -> str:
    tp, fp, fn = (f"count(*) FILTER (WHERE y_pred {a} {k} AND y_true {b} {k})" for a, b in (("=", "="), ("=", "<>"), ("<>", "=")))
    return f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)"


FM = f"""fm AS (SELECT symbol, fold, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) AS accuracy, {prf(1, 'long')}, {prf(2, 'short')},
  100.0 * count(*) FILTER (WHERE y_pred = 0) / count(*) AS hold_pct, 100.0 * count(*) FILTER (WHERE y_pred = 1) / count(*) AS long_pct, 100.0 * count(*) FILTER (WHERE y_pred = 2) / count(*) AS short_pct
  FROM mem WHERE role = 'test' GROUP BY 1, 2),
fn AS MATERIALIZED (SELECT *, 2 * precision_long * recall_long / (precision_long + recall_long + 1e-10) AS f1_long, 2 * precision_short * recall_short / (precision_short + recall_short + 1e-10) AS f1_short FROM fm),
fr AS MATERIALIZED (SELECT *, (f1_long + f1_short) / 2 AS f1_macro FROM fn)"""


def money(keys: str) -> str:
    return f"""ma AS (SELECT *, exp(sum(ln(1 + net_return)) OVER (PARTITION BY {keys} ORDER BY entry_bar)) AS e FROM led),
mb AS (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY entry_bar) AS pk FROM ma),
mc AS (SELECT {keys}, count(*) AS n, sum(net_return) AS tr, avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0 END) AS wr, sum(net_return) FILTER (WHERE net_return > 0) AS ws, -sum(net_return) FILTER (WHERE net_return < 0) AS ls,
  stddev_pop(net_return) AS sd, avg(net_return) AS mu, min((e - pk) / (pk + 1e-10)) AS md FROM mb GROUP BY {keys}),
mm AS MATERIALIZED (SELECT {keys}, n, CASE WHEN n < 3 THEN 0 ELSE greatest(-10, least(10, CASE WHEN sd < 1e-6 THEN sign(mu) * least(abs(mu) * 10, 3) ELSE mu / sd * sqrt(n) END)) END AS sharpe,
  CASE WHEN n < 3 THEN 0 ELSE least(99, CASE WHEN ls IS NULL THEN coalesce(ws, 0) ELSE coalesce(ws, 0) / (ls + 1e-10) END) END AS profit_factor, CASE WHEN n < 3 THEN 0 ELSE wr END AS win_rate, CASE WHEN n < 3 THEN 0 ELSE tr END AS total_return, CASE WHEN n < 3 THEN 0 ELSE md END AS max_drawdown FROM mc)"""


def first_word(text: str, words: list[str]) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({text}, '{w}') THEN '{w}' END" for w in words) + ")"


A_W, C_W = ["ond", "zz"], ["ation", "the"]


def news(title: str, avoid=A_W, caution=C_W, text: str | None = None) -> str:
    text = text or f"lower({title} || ' ' || left(text, 200))"
    return f"""hx AS (SELECT *, {text} AS tx FROM documents), hy AS (SELECT *, {first_word('tx', avoid)} AS aw, {first_word('tx', caution)} AS cw FROM hx),
hl AS (SELECT *, CASE WHEN aw IS NOT NULL THEN 'AVOID' WHEN cw IS NOT NULL THEN 'CAUTION' ELSE 'NEUTRAL' END AS news_state, coalesce(aw, cw) AS news_word FROM hy)"""


def batch(by: str, src: str = "hl") -> str:
    # the words of a batch: lowest list index among the rows of that state
    a = "CASE news_word " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(A_W)) + " END"
    c = "CASE news_word " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(C_W)) + " END"
    return f"""ba1 AS (SELECT {by}, count(*) AS headlines, min({a}) FILTER (WHERE news_state = 'AVOID') AS ai, min({c}) FILTER (WHERE news_state = 'CAUTION') AS ci FROM {src} GROUP BY 1),
ba2 AS (SELECT {by}, headlines, CASE WHEN ai IS NOT NULL THEN 'AVOID' WHEN ci IS NOT NULL THEN 'CAUTION' ELSE 'NEUTRAL' END AS news_state, coalesce({A_W}[ai + 1], {C_W}[ci + 1]) AS news_word FROM ba1)"""


def trade_sql() -> dict[str, str]:
    oc = "quantity pnl_gross pnl_net fee_paid slippage_cost"
    row = "symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, entry_bar, exit_bar, direction, exit_reason"
    fold_src = "fs AS (SELECT symbol, fold, pos, close, y_pred AS signal, CASE y_pred WHEN 1 THEN 1 WHEN 2 THEN -1 END AS direction FROM mem WHERE role = 'test')"
    q = {
        "outcomes_atr_levels": f"{HEAD}, {ATR} SELECT {row}, {r('entry_price exit_price', 6)}, {r(oc, 4)} FROM ox",
        "outcomes_percent_levels": f"{HEAD}, {PCT} SELECT {row}, {r('entry_price exit_price', 6)}, {r(oc, 4)} FROM ox",
        "outcomes_close_only": f"{HEAD}, {CLOSE} SELECT {row}, {r('entry_price exit_price', 6)}, {r('r_mult pnl_net', 4)} FROM ox WHERE exit_bar IS NOT NULL",
        "outcomes_fold_returns": f"{HEAD}, {SIG}, {fold_rows('sig', '0.6', '0.4')} SELECT symbol, entry_bar, exit_bar, direction, free_from, {r('net_return')} FROM ox WHERE exit_bar IS NOT NULL",
        "ledger_trades": f"{LED} SELECT symbol, entry_bar, exit_bar, direction, exit_reason, {r('pnl_net', 4)} FROM led",
        "ledger_metrics": f"{LED}, t AS (SELECT symbol, {TM} FROM led GROUP BY 1) SELECT symbol, n_trades, n_wins, n_losses, n_longs, n_shorts, min_hold_bars, max_hold_bars, {r('win_rate_pct avg_win avg_loss largest_win largest_loss avg_trade_pnl profit_factor total_fees_paid avg_hold_bars', 4)}, round(win_rate_pct / 100 * avg_win + (1 - win_rate_pct / 100) * avg_loss, 4) + 0.0 AS expectancy FROM t",
        "ledger_exit_reasons": f"{LED} SELECT symbol, exit_reason, count(*) AS n FROM led GROUP BY 1, 2",
        "ledger_totals": f"{LED} SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE pnl_net > 0) AS wins, round(sum(pnl_net), 4) + 0.0 AS realized_pnl, round(sum(fee_paid), 4) + 0.0 AS fees, round(sum(pnl_net) / 100, 4) + 0.0 AS return_pct FROM led GROUP BY 1",
        "ledger_r_report": f"""{HEAD}, {CLOSE}, {kept('exit_bar + 1')}, t AS (SELECT symbol, count(*) AS n_trades, count(*) FILTER (WHERE direction = 1) AS n_longs, count(*) FILTER (WHERE direction = -1) AS n_shorts,
 count(*) FILTER (WHERE exit_reason = 'TP') AS tp_exits, count(*) FILTER (WHERE exit_reason = 'SL') AS sl_exits, count(*) FILTER (WHERE exit_reason = 'TIMEOUT') AS timeout_exits,
 avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0 END) AS win_rate, coalesce(avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE direction = 1), 0) AS long_wr, coalesce(avg(CASE WHEN pnl_net > 0 THEN 1.0 ELSE 0 END) FILTER (WHERE direction = -1), 0) AS short_wr,
 avg(r_mult) AS expectancy_r, coalesce(avg(r_mult) FILTER (WHERE pnl_net > 0), 0) AS avg_r_win, coalesce(avg(r_mult) FILTER (WHERE pnl_net <= 0), 0) AS avg_r_loss,
 coalesce(sum(r_mult) FILTER (WHERE pnl_net > 0), 0) / (abs(coalesce(sum(r_mult) FILTER (WHERE pnl_net <= 0), 0)) + 1e-10) AS profit_factor, avg(exit_bar - entry_bar) AS avg_bars_held, sum(pnl_net) AS total_pnl, sum(pnl_net) / 10000 AS total_return FROM led GROUP BY 1)
SELECT symbol, n_trades, n_longs, n_shorts, tp_exits, sl_exits, timeout_exits, {r('win_rate long_wr short_wr expectancy_r avg_r_win avg_r_loss profit_factor avg_bars_held total_pnl total_return', 4)} FROM t""",
        "ledger_compound_metrics": f"{HEAD}, {SIG}, {fold_rows('sig', '0.0063', '0.0042')}, {kept('free_from')}, {money('symbol')} SELECT symbol, n, {r('sharpe profit_factor win_rate total_return max_drawdown', 4)} FROM mm",
        "ledger_cooldowns": f"{LED}, c AS (SELECT *, CAST(CASE exit_reason WHEN 'SL' THEN 5 WHEN 'TP' THEN 2 ELSE 3 END AS INTEGER) AS cooldown_bars FROM led) SELECT symbol, exit_bar, exit_reason, cooldown_bars, exit_bar + cooldown_bars AS ready_bar FROM c",
        "outcomes_two_leg_pnl": """WITH a AS (SELECT CASE WHEN l_linestatus = 'F' THEN 'long' ELSE 'short' END AS side, CASE WHEN l_linestatus = 'F' THEN 1 ELSE -1 END AS sg, l_extendedprice / 100 AS e, l_tax AS t, l_discount AS d, l_quantity AS q FROM lineitem),
b AS (SELECT side, sg * d * q / 4 + sg * t * q * 0.75 AS g, (e * q + (e + d) * q / 4 + (e + t) * q * 0.75) * 0.0005 AS f FROM a) SELECT side, count(*) AS n, round(sum(g), 1) AS pnl_gross, round(sum(f), 1) AS fee_usdt, round(sum(g - f), 1) AS pnl_net FROM b GROUP BY 1""",
        "equity_curve": f"{EQ} SELECT symbol, bar_ix, {r('equity', 4)} FROM eq",
        "equity_drawdown": f"{EQ} SELECT symbol, bar_ix, {r('peak', 4)}, {r('drawdown', 5)} FROM dx2",
        "equity_drawdown_runs": f"""{EQ}, ru AS (SELECT symbol, drawdown < -0.001 AS ind0, sum(CASE WHEN drawdown < -0.001 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_ix) AS run FROM dx2),
rl AS (SELECT symbol, run, count(*) FILTER (WHERE ind0) AS b FROM ru GROUP BY 1, 2) SELECT symbol, max(b) AS max_drawdown_bars, count(*) FILTER (WHERE b > 0) AS n_drawdowns, round(coalesce(avg(b) FILTER (WHERE b > 0), 0), 4) + 0.0 AS avg_drawdown_bars FROM rl GROUP BY 1""",
        "performance_grades": f"""{EQ}, t AS (SELECT symbol, {TM} FROM led GROUP BY 1),
em AS (SELECT symbol, count(*) AS n_bars, arg_min(equity, bar_ix) AS e0, arg_max(equity, bar_ix) AS final_capital, 100 * min(drawdown) AS max_drawdown_pct, min(equity - peak) AS max_drawdown_usdt,
  CASE WHEN stddev_pop(ret) > 1e-10 THEN avg(ret - {RF}) / stddev_pop(ret - {RF}) * sqrt(35040) ELSE 0 END AS sharpe_ratio,
  CASE WHEN count(ret) FILTER (WHERE ret - {RF} < 0) > 1 THEN avg(ret - {RF}) / (stddev_pop(ret - {RF}) FILTER (WHERE ret - {RF} < 0) + 1e-10) * sqrt(35040) ELSE 0 END AS sortino_ratio FROM dx2 GROUP BY 1),
pm AS (SELECT em.*, n_trades, profit_factor, win_rate_pct, (final_capital / e0 - 1) * 100 AS total_return_pct FROM em JOIN t USING (symbol))
SELECT symbol, n_bars, n_trades, CASE WHEN sharpe_ratio > 2 AND profit_factor > 2 AND win_rate_pct > 60 AND abs(max_drawdown_pct) < 15 THEN 'A+' WHEN sharpe_ratio > 1.5 AND profit_factor > 1.8 AND win_rate_pct > 55 AND abs(max_drawdown_pct) < 20 THEN 'A'
  WHEN sharpe_ratio > 1 AND profit_factor > 1.5 AND win_rate_pct > 50 AND abs(max_drawdown_pct) < 25 THEN 'B' WHEN sharpe_ratio > 0.5 AND profit_factor > 1.2 AND win_rate_pct > 45 AND abs(max_drawdown_pct) < 35 THEN 'C' WHEN sharpe_ratio > 0 AND profit_factor > 1 THEN 'D' ELSE 'F' END AS grade,
  {r('final_capital total_return_pct max_drawdown_pct max_drawdown_usdt sharpe_ratio sortino_ratio profit_factor', 3)} FROM pm""",
        "portfolio_equity": f"{EQ}, c AS (SELECT min(m) AS cut FROM (SELECT max(bar_ix) AS m FROM eq GROUP BY symbol)) SELECT bar_ix, count(*) AS n_symbols, round(sum(equity / (SELECT count(DISTINCT symbol) FROM eq)), 4) + 0.0 AS equity FROM eq, c WHERE bar_ix <= cut GROUP BY 1",
        "portfolio_equity_correlation": f"""{EQ}, c AS (SELECT min(m) AS cut FROM (SELECT max(bar_ix) AS m FROM eq GROUP BY symbol)), rr AS (SELECT dd.* FROM dd, c WHERE bar_ix <= cut AND ret IS NOT NULL)
SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, count(*) AS n, round(corr(a.ret, b.ret), 5) + 0.0 AS corr FROM rr a JOIN rr b ON a.bar_ix = b.bar_ix AND a.symbol <= b.symbol GROUP BY 1, 2""",
        "positions_mark_to_market": f"WITH {POS}, t AS (SELECT count(*) AS positions, sum(sg * (price - entry_price) * quantity) AS unrealized_pnl, sum(entry_price * quantity / 10) AS used_margin FROM pe WHERE quantity >= 60) SELECT positions, {r('unrealized_pnl used_margin', 4)}, round(10000 + unrealized_pnl, 4) + 0.0 AS total_balance, round(10000 - used_margin, 4) + 0.0 AS available_balance FROM t",
        "positions_reconciled": f"""WITH {POS}, t AS (SELECT *, CASE WHEN quantity >= 60 AND quantity <= 75 THEN 'A' WHEN quantity >= 60 THEN 'B' WHEN quantity <= 75 THEN 'C' ELSE 'D' END AS state, entry_price * (1 + sg * 0.5) AS tp, entry_price * (1 - sg * 0.25) AS sl FROM pe)
SELECT symbol, state, CASE WHEN state = 'B' THEN CASE WHEN sg * (price - tp) >= 0 THEN 'TP_EXTERNAL' WHEN sg * (price - sl) <= 0 THEN 'SL_EXTERNAL' ELSE 'EXTERNALLY_CLOSED' END END AS exit_reason,
  round(CASE WHEN state = 'B' THEN greatest(-9999, least(9999, sg * (price - entry_price) / abs(entry_price - sl))) END, 4) + 0.0 AS pnl_r FROM t""",
        "risk_rolling_win_rate": f"WITH {JOURNAL}, {ROLL20} SELECT symbol, side, trade_id, n_recent, round(wr, 5) + 0.0 AS win_rate, round(adj, 5) + 0.0 AS threshold_adj FROM ka",
        "risk_recalibration": f"WITH {JOURNAL}, {ROLL20} SELECT symbol, side, arg_max(n_recent, rn) AS n_recent, round(arg_max(wr, rn), 5) + 0.0 AS win_rate, round(arg_max(adj, rn), 5) + 0.0 AS threshold_adj FROM ka GROUP BY 1, 2",
        "risk_streaks": f"WITH {JOURNAL}, {STREAK} SELECT symbol, side, trade_id, streak FROM sb",
        "risk_loss_blocks": f"WITH {JOURNAL}, {STREAK} SELECT symbol, side, exit_bar AS block_from, exit_bar + 8 AS block_to FROM sb WHERE streak <= -3",
        "equity_annualised": f"""{EQ}, am AS (SELECT symbol, count(*) AS n_bars, arg_min(equity, bar_ix) AS initial_capital, arg_max(equity, bar_ix) AS final_capital, min(drawdown) * 100 AS mdd FROM dx2 GROUP BY 1),
an AS (SELECT *, final_capital / initial_capital AS total_return_x, power(final_capital / initial_capital, 1.0 / greatest(n_bars / 8760.0, 1e-6)) - 1 AS ann FROM am),
ao AS (SELECT *, least(ann * 100, 1e6) AS annualized_return_pct, least(ann / (abs(mdd / 100) + 1e-10), 1e6) AS calmar_ratio FROM an)
SELECT symbol, n_bars, {r('annualized_return_pct calmar_ratio initial_capital', 2)}, {r('total_return_x', 6)} FROM ao""",
        "risk_blocked_entries": f"""WITH {JOURNAL}, {STREAK}, cl AS (SELECT DISTINCT symbol, side, exit_bar + i AS pos FROM sb, (SELECT unnest(range(8)) AS i) WHERE streak <= -9)
SELECT j.symbol, j.side, cl.pos IS NOT NULL AS blocked, count(*) AS n FROM j LEFT JOIN cl ON j.symbol = cl.symbol AND j.side = cl.side AND j.exit_bar = cl.pos GROUP BY 1, 2, 3""",
        "risk_session_loss": f"""WITH {JOURNAL}, a AS (SELECT *, sum(-pnl) OVER w AS s FROM j WINDOW w AS (PARTITION BY symbol, ts::DATE ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, trade_id ROWS UNBOUNDED PRECEDING)) AS open_loss FROM a) SELECT symbol, trade_id, round(open_loss, 3) + 0.0 AS open_loss, open_loss / 10000000 * 100 >= 5 AS limit_hit FROM b""",
        "risk_recovery_ledger": f"""{LED}, a AS (SELECT *, CASE WHEN pnl_net < 0 THEN exit_bar END AS lb FROM led), b AS (SELECT *, max(lb) OVER (PARTITION BY symbol ORDER BY exit_bar, entry_bar ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM a),
c AS (SELECT *, sum(CASE WHEN exit_bar - pl >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY exit_bar, entry_bar) AS episode FROM b), d AS (SELECT *, sum(-pnl_net) OVER (PARTITION BY symbol, episode ORDER BY exit_bar, entry_bar) AS s FROM c),
e0 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol, episode ORDER BY exit_bar, entry_bar)) AS to_recover FROM d) SELECT symbol, entry_bar, CAST(episode AS BIGINT) AS episode, round(to_recover, 3) + 0.0 AS to_recover, to_recover > 0 AS in_recovery FROM e0""".replace("a AS (SELECT *, CASE", "ra1 AS (SELECT *, CASE").replace("FROM a)", "FROM ra1)").replace(", b AS (SELECT *, max(lb)", ", rb1 AS (SELECT *, max(lb)").replace("AS episode FROM b)", "AS episode FROM rb1)").replace("\nc AS (SELECT *, sum", "\nrc1 AS (SELECT *, sum").replace(", d AS (SELECT *, sum(-pnl_net)", ", rd1 AS (SELECT *, sum(-pnl_net)").replace("AS s FROM c)", "AS s FROM rc1)").replace("AS to_recover FROM d)", "AS to_recover FROM rd1)"),
        "risk_kelly_inputs": f"WITH {JOURNAL}, {KELLY} SELECT symbol, trade_id, round(win_rate, 5) + 0.0 AS win_rate, round(avg_win, 7) + 0.0 AS avg_win, round(avg_loss, 7) + 0.0 AS avg_loss FROM kel",
        **{f"risk_size_{m}": sizing(m) for m in ("fixed_fractional", "kelly", "half_kelly", "vol_scaled")},
        "risk_sized_trades": f"{SIZED} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, side, why IS NULL AS approved, why AS reject_reason, round(CASE WHEN why IS NULL THEN tp ELSE e END, 4) + 0.0 AS take_profit, round(CASE WHEN why IS NULL THEN sl ELSE e END, 4) + 0.0 AS stop_loss, round(CASE WHEN why IS NULL THEN qty ELSE 0 END, 3) + 0.0 AS quantity FROM r6",
        "risk_gated_trades": f"{GATED} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, side, why IS NULL AS approved, why AS reject_reason, CAST(CASE WHEN why IS NULL THEN lever ELSE 1 END AS INTEGER) AS leverage, round(CASE WHEN why IS NULL THEN tp ELSE e END, 4) + 0.0 AS take_profit, round(CASE WHEN why IS NULL THEN sl ELSE e END, 4) + 0.0 AS stop_loss, round(CASE WHEN why IS NULL THEN qty ELSE 0 END, 3) + 0.0 AS quantity FROM r6",
        "signals_payoff_gate": f"""{SIZED}, g1 AS (SELECT *, e * qty * CAST(0.001 AS DOUBLE) AS fee, abs(e - sl) * qty * tpm / slm AS gross, abs(tp - e) * qty AS w1, abs(e - sl) * qty AS l1x FROM r6 WHERE why IS NULL),
g2 AS (SELECT *, (w1 - fee) / (l1x + fee) AS net_rr FROM g1) SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, side, CASE WHEN atr IS NULL OR atr <= 0 OR qty <= 0 THEN NULL WHEN gross < fee * 2.5 THEN 'payoff below fees' WHEN w1 - fee <= 0 OR net_rr < 1.2 THEN 'net reward too small' END AS payoff_skip, {r('net_rr', 4)} FROM g2""",
        "risk_throttled_entries": f"""{HEAD}, {SIG}, cd AS MATERIALIZED (SELECT *, ts::DATE AS dy, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS rn FROM sig WHERE signal > 0),
wk AS (SELECT symbol, rn, pos, dy, true AS keep, pos AS lastpos, 1 AS cnt FROM cd WHERE rn = 1 UNION ALL
 SELECT c.symbol, c.rn, c.pos, c.dy, c.pos - w.lastpos >= 6 AND (CASE WHEN c.dy = w.dy THEN w.cnt ELSE 0 END) < 4,
  CASE WHEN c.pos - w.lastpos >= 6 AND (CASE WHEN c.dy = w.dy THEN w.cnt ELSE 0 END) < 4 THEN c.pos ELSE w.lastpos END,
  (CASE WHEN c.dy = w.dy THEN w.cnt ELSE 0 END) + CASE WHEN c.pos - w.lastpos >= 6 AND (CASE WHEN c.dy = w.dy THEN w.cnt ELSE 0 END) < 4 THEN 1 ELSE 0 END FROM wk w JOIN cd c ON c.symbol = w.symbol AND c.rn = w.rn + 1)
SELECT cd.symbol, strftime(cd.ts, '%Y-%m-%d %H:%M:%S') AS ts, cd.pos, cd.signal FROM wk JOIN cd USING (symbol, rn) WHERE keep""",
        "folds_membership": f"WITH {bars()}, n AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM bars), {FOLDS.format('n')} SELECT symbol, fold, role, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM mem WHERE role IS NOT NULL GROUP BY 1, 2, 3",
        "evaluation_folds": f"{PRED}, {FOLDS.format('pred')}, {FM} SELECT symbol, fold, n, {r('accuracy precision_long recall_long f1_long precision_short recall_short f1_short f1_macro hold_pct long_pct short_pct', 4)} FROM fr",
        "evaluation_fold_summary": f"""{PRED}, {FOLDS.format('pred')}, {FM}, {fold_src}, {fold_rows('fs', '0.0063', '0.0042', 'symbol, fold')}, {kept('free_from', ('symbol', 'fold'))}, {money('symbol, fold')},
su AS (SELECT fr.symbol, count(*) AS n_folds, avg(accuracy) AS mean_accuracy, avg(f1_macro) AS mean_f1_macro, avg(sharpe) AS mean_sharpe, avg(profit_factor) AS mean_profit_factor, avg(win_rate) AS mean_win_rate, stddev_pop(sharpe) AS std_sharpe, avg(CASE WHEN sharpe > 0 THEN 1.0 ELSE 0 END) AS consistency FROM fr JOIN mm USING (symbol, fold) GROUP BY 1),
sw AS (SELECT *, concat_ws(', ', CASE WHEN mean_sharpe < 0.3 THEN 'sharpe' END, CASE WHEN mean_f1_macro < 0.33 THEN 'f1' END, CASE WHEN consistency < 0.6 THEN 'consistency' END) AS why FROM su)
SELECT symbol, n_folds, why = '' AS accepted, CASE WHEN why = '' THEN 'ACCEPT' ELSE 'REJECT (' || why || ')' END AS recommendation, {r('mean_accuracy mean_f1_macro mean_sharpe mean_profit_factor mean_win_rate std_sharpe consistency', 4)} FROM sw""",
        "evaluation_classes": f"{PRED}, ks AS (SELECT unnest([0, 1, 2]) AS label), cm AS (SELECT symbol, label, count(*) FILTER (WHERE y_pred = label AND y_true = label) AS tp, count(*) FILTER (WHERE y_pred = label AND y_true <> label) AS fp, count(*) FILTER (WHERE y_pred <> label AND y_true = label) AS fneg FROM pred, ks GROUP BY 1, 2) SELECT symbol, label, tp + fneg AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 5) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fneg, 0), 0), 5) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fneg, 0), 0), 5) + 0.0 AS f1 FROM cm",
        "evaluation_predictions": f"""{PRED}, t AS (SELECT symbol, count(*) AS n_samples, count(*) FILTER (WHERE y_pred = 0) / count(*) AS hold_pct, count(*) FILTER (WHERE y_pred = 1) / count(*) AS long_pct, count(*) FILTER (WHERE y_pred = 2) / count(*) AS short_pct, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0 END) AS accuracy,
 ({f1k(0)} + {f1k(1)} + {f1k(2)}) / 3 AS f1_macro, avg(confidence) AS mean_conf, quantile_cont(confidence, 0.25) AS conf_p25, quantile_cont(confidence, 0.5) AS conf_p50, quantile_cont(confidence, 0.75) AS conf_p75, quantile_cont(confidence, 0.9) AS conf_p90 FROM pred GROUP BY 1)
SELECT symbol, n_samples, concat_ws(';', CASE WHEN hold_pct > 0.55 THEN 'hold-biased' END, CASE WHEN long_pct < 0.05 OR short_pct < 0.05 THEN 'one direction absent' END, CASE WHEN mean_conf < 0.36 THEN 'mean confidence low' END, CASE WHEN mean_conf > 0.75 THEN 'mean confidence high' END) AS issues,
 {r('hold_pct long_pct short_pct accuracy f1_macro mean_conf conf_p25 conf_p50 conf_p75 conf_p90', 4)} FROM t""",
        "evaluation_regimes": f"""{PRED}, {REGIME_FLAGS}, g0 AS (SELECT p.symbol, p.y_true = p.y_pred AS okay, unnest(list_filter([CASE WHEN regime_trending = 1 THEN 'trending' END, CASE WHEN regime_trending = 0 THEN 'ranging' END, CASE WHEN regime_high_vol = 1 THEN 'high_vol' END, CASE WHEN regime_low_vol = 1 THEN 'low_vol' END, CASE WHEN regime_bull_20 = 1 THEN 'bull_20' END, CASE WHEN regime_bear_20 = 1 THEN 'bear_20' END], lambda x: x IS NOT NULL)) AS regime_group FROM pred p JOIN flags USING (symbol, pos))
SELECT symbol, regime_group, count(*) AS n, round(avg(CASE WHEN okay THEN 1.0 ELSE 0 END), 5) + 0.0 AS accuracy FROM g0 GROUP BY 1, 2 HAVING count(*) >= 50""",
        "evaluation_document_labels": "WITH ks AS (SELECT unnest([0, 1]) AS label), pred AS (SELECT lang AS symbol, quality AS y_true, toxic AS y_pred FROM labels JOIN documents USING (doc_id)), cm AS (SELECT symbol, label, count(*) FILTER (WHERE y_pred = label AND y_true = label) AS tp, count(*) FILTER (WHERE y_pred = label AND y_true <> label) AS fp, count(*) FILTER (WHERE y_pred <> label AND y_true = label) AS fneg FROM pred, ks GROUP BY 1, 2) SELECT symbol, label, tp + fneg AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 5) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fneg, 0), 0), 5) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fneg, 0), 0), 5) + 0.0 AS f1 FROM cm",
        "evaluation_holdout": f"WITH {bars()}, n AS (SELECT *, row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS nn FROM bars), m AS (SELECT *, CASE WHEN pos >= nn - floor(nn * 0.2) THEN 'test' ELSE 'train' END AS role FROM n) SELECT symbol, role, count(*) AS n, min(pos) AS first_pos FROM m GROUP BY 1, 2",
        "bars_last_rows": f"WITH {bars()}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) SELECT {KEY}, close FROM n WHERE k <= 200",
        "bars_latest": f"WITH {bars('1h', 'user_id')}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) SELECT {KEY}, close, volume FROM n WHERE k = 1",
        "labels_issues": f"WITH {bars()}, {ind()}, {barrier(8, '1.5')}, t AS ({DIST}) SELECT symbol, concat_ws(';', CASE WHEN hold_pct < 10 THEN 'low hold' END, CASE WHEN long_pct < 10 THEN 'low long' END, CASE WHEN short_pct < 10 THEN 'low short' END, CASE WHEN hold_pct >= 10 AND hold_pct < 20 THEN 'somewhat low hold' END, CASE WHEN long_pct >= 10 AND long_pct < 20 THEN 'somewhat low long' END, CASE WHEN short_pct >= 10 AND short_pct < 20 THEN 'somewhat low short' END, CASE WHEN greatest(long_pct, short_pct) > 60 THEN 'one-sided' END) AS label_issues, hold_pct > 15 AND long_pct > 15 AND short_pct > 15 AS balanced, hold_pct < 20 AS abort_training FROM t",
        "quality_report": f"""WITH {bars()}, n AS (SELECT *, row_number() OVER w - 1 AS pos, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS {W}), v AS (SELECT *, {roll('stddev_samp(ret)', 20, 1)} AS vol FROM n),
b AS (SELECT symbol, count(*) AS bars, CAST(floor((epoch(max(ts)) - epoch(min(ts))) / 86400) AS BIGINT) AS days, count(*) FILTER (WHERE close <= 0) AS bad_prices, count(*) FILTER (WHERE abs(ret) > 0.2) AS spikes, quantile_cont(vol, 0.7) AS q7, quantile_cont(vol, 0.3) AS q3, count(vol) AS nv, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0 END) AS zero_volume, median(close) AS median_price FROM v GROUP BY 1),
sh AS (SELECT v.symbol, count(*) FILTER (WHERE vol > q7) AS hi, count(*) FILTER (WHERE vol < q3) AS lo FROM v JOIN b USING (symbol) GROUP BY 1),
dy AS (SELECT symbol, ts::DATE AS d, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2), dz AS (SELECT symbol, c, lag(c) OVER (PARTITION BY symbol ORDER BY d) AS pc FROM dy), du AS (SELECT symbol, count(*) FILTER (WHERE c > pc) AS up_days, count(*) FILTER (WHERE c < pc) AS down_days FROM dz GROUP BY 1),
z AS (SELECT *, hi / nv AS high_vol_share, lo / nv AS low_vol_share, up_days / (up_days + down_days) AS up_share FROM b JOIN sh USING (symbol) JOIN du USING (symbol)),
z2 AS (SELECT *, concat_ws(';', CASE WHEN bars < 500 THEN 'min_bars' END, CASE WHEN days < 14 THEN 'min_days' END, CASE WHEN bad_prices > 0 THEN 'positive_prices' END, CASE WHEN NOT (high_vol_share > 0.1 AND low_vol_share > 0.1) THEN 'regime_coverage' END, CASE WHEN zero_volume >= 0.01 THEN 'volume_non_zero' END) AS failed FROM z)
SELECT symbol, bars, days, CAST(0 AS BIGINT) AS null_values, bad_prices, CAST(0 AS BIGINT) AS duplicates, spikes, up_days, down_days, failed = '' AS ok, {r('high_vol_share low_vol_share up_share zero_volume median_price', 4)}, failed, concat_ws(';', CASE WHEN spikes > 0 THEN 'price spikes' END, CASE WHEN up_share > 0.7 THEN 'mostly rising days' END, CASE WHEN up_share < 0.35 THEN 'mostly falling days' END, CASE WHEN zero_volume > 0.005 THEN 'zero-volume bars' END) AS warnings FROM z2""",
        "journal_regimes": f"WITH {JOURNAL} SELECT symbol, regime, count(*) AS trades, count(*) FILTER (WHERE won) AS wins, round(sum(pnl), 2) + 0.0 AS net_pnl, round(count(*) FILTER (WHERE won) / count(*), 5) + 0.0 AS win_rate FROM j GROUP BY 1, 2",
        "journal_struggling": f"WITH {JOURNAL}, t AS (SELECT symbol, regime, count(*) AS n, count(*) FILTER (WHERE won) / count(*) AS wr FROM j GROUP BY 1, 2) SELECT DISTINCT symbol FROM t WHERE n >= 8 AND wr < 0.63",
        "journal_recent": f"WITH {JOURNAL} SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 30 DAY) AS recent_trades FROM j",
        "journal_parsed": """SELECT o_orderpriority AS symbol, CASE WHEN o_orderkey % 3 = 0 THEN 'long' ELSE 'short' END AS side, 'UNKNOWN' AS exit_reason, 3 AS bars_held, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 180000) AS n_won,
  round(sum(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1.5 END)::DOUBLE, 2) AS pnl_r, CAST(0 AS DOUBLE) AS confidence FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 3 < 2 GROUP BY 1, 2""",
        "journal_retrain_due": f"""WITH {JOURNAL}, t AS (SELECT symbol, count(*) AS n_trades, CASE WHEN symbol = '5-LOW' THEN 9999 WHEN symbol = '1-URGENT' THEN 2 ELSE CAST(floor((epoch(TIMESTAMP '2001-08-12') - epoch(max(ts))) / 86400) AS BIGINT) END AS days_since FROM j GROUP BY 1)
SELECT symbol, days_since, n_trades, days_since >= 7 AND n_trades >= 30 AS due, CASE WHEN days_since < 7 THEN 'not due' WHEN n_trades < 30 THEN 'too few trades' ELSE 'scheduled' END AS reason FROM t""",
        "records_trade_open": f"""{LED} SELECT symbol, CASE WHEN direction = 1 THEN 'long' ELSE 'short' END AS side, 10 AS leverage, exit_reason AS regime, strftime(ts, '%Y-%m-%d %H:%M:%S') AS opened_at, round(entry_price, 7) + 0.0 AS entry_price, round(quantity, 7) + 0.0 AS quantity,
  round(entry_price * (1 + direction * 0.02), 7) + 0.0 AS tp_price, round(entry_price * (1 - direction * 0.01), 7) + 0.0 AS sl_price, round(confidence, 2) + 0.0 AS confidence FROM led""",
        "records_trade_close": f"WITH {JOURNAL} SELECT symbol, side, count(*) AS n, max(round(greatest(-9999, least(9999, pnl / 7)), 4)) AS max_r, min(round(greatest(-9999, least(9999, pnl / 7)), 4)) AS min_r, round(sum(round(pnl - abs(pnl) / 1000, 4)), 2) AS net_pnl, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_close FROM j GROUP BY 1, 2",
        "news_headlines": f"WITH {news('source')} SELECT doc_id, news_state, news_word FROM hl",
        "news_default_words": f"WITH {news('', AVOID_WORDS, CAUTION_WORDS, 'lower(text)')} SELECT news_state, coalesce(news_word, '') AS news_word, count(*) AS n FROM hl GROUP BY 1, 2",
        "news_batches": f"WITH {news('source')}, {batch('source')} SELECT source, headlines, news_state, news_word FROM ba2",
        "news_payloads": f"WITH {news('lang')} SELECT news_state, count(*) AS n FROM hl GROUP BY 1",
        "news_sentiment": f"""WITH {news('source')}, fg AS (SELECT strftime(ts, '%Y-%m-%d') AS day, arg_max(CAST(json_extract_string(props, '$.k') AS INTEGER), event_id) AS fng_value FROM events GROUP BY 1),
dl AS (SELECT *, '2024-01-' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') AS day FROM hl), top3 AS (SELECT * FROM dl QUALIFY row_number() OVER (PARTITION BY day ORDER BY doc_id DESC) <= 20), {batch('day', 'top3')},
z0 AS (SELECT ba2.*, coalesce(fng_value, 50) AS fng_value FROM ba2 LEFT JOIN fg USING (day)), z AS (SELECT *, CASE WHEN fng_value <= 20 OR fng_value >= 80 THEN 'CAUTION' ELSE 'NEUTRAL' END AS fng_state, CASE WHEN fng_value <= 20 THEN 'Extreme Fear (FnG=' || fng_value || ')' WHEN fng_value >= 80 THEN 'Extreme Greed (FnG=' || fng_value || ')' END AS fr, 'keyword: ''' || news_word || '''' AS wr FROM z0)
SELECT day, fng_value, news_state, fng_state, CASE WHEN news_state = 'AVOID' THEN 'AVOID' WHEN news_state = 'CAUTION' OR fng_state = 'CAUTION' THEN 'CAUTION' ELSE 'NEUTRAL' END AS sentiment,
  CASE WHEN news_state = 'AVOID' THEN wr WHEN news_state = 'CAUTION' OR fng_state = 'CAUTION' THEN concat_ws(' | ', fr, wr) WHEN fng_value <> 0 THEN 'FnG=' || fng_value ELSE 'OK' END AS sentiment_reason FROM z""",
        "logs_routed": """WITH a AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'info' WHEN 'fr' THEN 'warning' WHEN 'de' THEN 'debug' ELSE 'error' END AS level, CASE source WHEN 'src0' THEN 'core.trader.x' WHEN 'src1' THEN 'core.exchange' WHEN 'src2' THEN 'core.market.news' WHEN 'src3' THEN 'asyncio' ELSE 'other' END AS lg, text FROM documents),
b AS (SELECT *, lg || ' — ' || text AS m FROM a) SELECT level, CASE WHEN starts_with(lg, 'core.trader') THEN 'bot' WHEN starts_with(lg, 'core.exchange') THEN 'trade' WHEN starts_with(lg, 'core.market') THEN 'signal' ELSE 'bot' END AS channel, CAST(least(length(m), 2000) AS INTEGER) AS chars, doc_id
FROM b WHERE level <> 'debug' AND NOT contains(m, '[Reporter]') AND NOT contains(m, 'ccxt') AND NOT contains(m, 'aiohttp') AND NOT contains(m, 'asyncio')""",
    }
    return q


BOOK = f"""{HEAD}, {ATR}, bc AS MATERIALIZED (SELECT o.symbol, o.ts, CAST(epoch(o.ts) // 3600 AS BIGINT) AS t0, CAST(epoch(e.ts) // 3600 AS BIGINT) AS xt, o.direction AS d, o.pnl_net AS p, o.confidence AS cf,
  row_number() OVER (ORDER BY o.ts, o.symbol) AS rn FROM ox o JOIN ind e ON e.symbol = o.symbol AND e.pos = o.exit_bar)"""
BOOK_ROW = "symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, reason = '' AS entered, reason AS reject_reason, CAST(held AS INTEGER) AS open_trades"


def book_sql() -> dict[str, str]:
    """Recursion over the candidates, one row at a time."""
    def side(k: str) -> str:
        return (f"CASE WHEN {k}x <= t0 THEN CASE WHEN {k}p < 0 THEN {k}n + 1 ELSE 0 END ELSE {k}n END AS {k}n1, "
                f"CASE WHEN {k}x <= t0 AND {k}p < 0 AND {k}n + 1 >= 3 THEN {k}x + 8 ELSE {k}u END AS {k}u1, "
                f"CASE WHEN {k}x > t0 THEN {k}x END AS {k}x1")

    def slot(k: str, sign: int) -> str:
        mine = f"reason = '' AND d = {sign}"
        return (f"CASE WHEN {mine} THEN xt ELSE {k}x1 END, CASE WHEN {mine} THEN p ELSE {k}p END, "
                f"CASE WHEN {mine} THEN symbol ELSE {k}s END, {k}n1, {k}u1")

    return {
        "risk_book_entries": f"""{BOOK}, st AS (SELECT 0::BIGINT AS rn, ''::VARCHAR AS symbol, NULL::TIMESTAMP AS ts, ''::VARCHAR AS reason, 0::BIGINT AS held,
  NULL::BIGINT AS lx, 0::DOUBLE AS lp, ''::VARCHAR AS ls, 0::BIGINT AS ln, 0::BIGINT AS lu, NULL::BIGINT AS sx, 0::DOUBLE AS sp, ''::VARCHAR AS ss, 0::BIGINT AS sn, 0::BIGINT AS su
 UNION ALL SELECT rn, symbol, ts, reason, held, {slot('l', 1)}, {slot('s', -1)} FROM (
  SELECT *, CASE WHEN (lx1 IS NOT NULL AND ls = symbol) OR (sx1 IS NOT NULL AND ss = symbol) THEN 'symbol is open' WHEN CASE WHEN d = 1 THEN lx1 ELSE sx1 END IS NOT NULL THEN 'direction is open'
    WHEN t0 < CASE WHEN d = 1 THEN lu1 ELSE su1 END THEN 'loss streak' ELSE '' END AS reason, CAST(lx1 IS NOT NULL AS BIGINT) + CAST(sx1 IS NOT NULL AS BIGINT) AS held FROM (
   SELECT c.*, st.* EXCLUDE (rn, symbol, ts, reason, held), {side('l')}, {side('s')} FROM st JOIN bc c ON c.rn = st.rn + 1)))
SELECT {BOOK_ROW} FROM st WHERE rn > 0""",
        "risk_book_capacity": f"""{BOOK}, st AS (SELECT 0::BIGINT AS rn, ''::VARCHAR AS symbol, NULL::TIMESTAMP AS ts, ''::VARCHAR AS reason, 0::BIGINT AS held, CAST([] AS STRUCT(x BIGINT, s VARCHAR, d INTEGER)[]) AS o
 UNION ALL SELECT rn, symbol, ts, reason, held, CASE WHEN reason = '' THEN list_append(o1, {{'x': xt, 's': symbol, 'd': d::INTEGER}}) ELSE o1 END FROM (
  SELECT *, len(o1) AS held, CASE WHEN len(o1) >= 3 THEN 'max open trades' WHEN len(list_filter(o1, lambda q: q.s = symbol)) > 0 THEN 'symbol is open' WHEN len(list_filter(o1, lambda q: q.d = d)) >= 2 THEN 'direction is open' ELSE '' END AS reason FROM (
   SELECT c.*, list_filter(st.o, lambda q: q.x > c.t0) AS o1 FROM st JOIN bc c ON c.rn = st.rn + 1)))
SELECT {BOOK_ROW} FROM st WHERE rn > 0""",
        "risk_closed_loop": f"""{HEAD}, {ATR}, bc AS MATERIALIZED (SELECT symbol, entry_bar AS t0, exit_bar AS xt, direction AS d, pnl_net AS p, confidence AS cf, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar) AS rn FROM ox),
st AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, NULL::BIGINT AS t0, ''::VARCHAR AS reason, 1::DOUBLE AS factor, 0::DOUBLE AS shown, 0::DOUBLE AS taken, NULL::BIGINT AS ox_, 0::BIGINT AS od_, 0::DOUBLE AS op_,
  0::BIGINT AS ln, 0::BIGINT AS lu, 0::BIGINT AS sn, 0::BIGINT AS su, 0::DOUBLE AS owed, 0::BIGINT AS since, 0::BIGINT AS att FROM bc
 UNION ALL SELECT symbol, rn, t0, reason, factor, owed3, CASE WHEN reason = '' THEN p * factor ELSE 0 END, CASE WHEN reason = '' THEN xt WHEN NOT cl THEN ox_ END, CASE WHEN reason = '' THEN d ELSE od_ END, CASE WHEN reason = '' THEN p * factor ELSE op_ END,
   ln1, lu1, sn1, su1, owed3, CASE WHEN reason = '' AND owed3 > 0 THEN t0 ELSE since2 END, CASE WHEN reason = '' AND owed3 > 0 THEN att3 + 1 ELSE att3 END FROM (
  SELECT *, CASE WHEN reason = '' AND owed3 > 0 THEN least(power(1.5, att3), 3) ELSE 1 END AS factor FROM (
   SELECT *, CASE WHEN owed3 > 0 THEN att2 ELSE 0 END AS att3, CASE WHEN ox_ IS NOT NULL AND NOT cl THEN 'symbol is open' WHEN t0 < CASE WHEN d = 1 THEN lu1 ELSE su1 END THEN 'loss streak' WHEN owed3 > 0 AND cf < 0.7 THEN 'recovery wait' ELSE '' END AS reason FROM (
    SELECT *, CASE WHEN owed2 > 0 AND since2 + 6 <= t0 THEN 0 ELSE owed2 END AS owed3 FROM (
     SELECT *, CASE WHEN lost THEN owed1 - op_ WHEN cl THEN greatest(0, owed1 - op_) ELSE owed1 END AS owed2, CASE WHEN lost THEN ox_ ELSE since END AS since2, CASE WHEN lost OR owed1 = 0 THEN 0 ELSE att END AS att2,
       CASE WHEN cl AND od_ = 1 THEN CASE WHEN lost THEN ln + 1 ELSE 0 END ELSE ln END AS ln1, CASE WHEN lost AND od_ = 1 AND ln + 1 >= 3 THEN ox_ + 8 ELSE lu END AS lu1,
       CASE WHEN cl AND od_ = -1 THEN CASE WHEN lost THEN sn + 1 ELSE 0 END ELSE sn END AS sn1, CASE WHEN lost AND od_ = -1 AND sn + 1 >= 3 THEN ox_ + 8 ELSE su END AS su1 FROM (
      SELECT *, cl AND op_ < 0 AS lost, CASE WHEN owed > 0 AND since + 6 <= CASE WHEN cl THEN ox_ ELSE t0 END THEN 0 ELSE owed END AS owed1 FROM (
       SELECT c.*, st.* EXCLUDE (symbol, rn, t0, reason, factor, shown, taken), coalesce(st.ox_ <= c.t0, false) AS cl FROM st JOIN bc c ON c.symbol = st.symbol AND c.rn = st.rn + 1)))))))
SELECT symbol, t0 AS entry_bar, reason = '' AS entered, reason AS reject_reason, round(factor, 4) + 0.0 AS size_factor, round(shown, 3) + 0.0 AS to_recover, round(taken, 3) + 0.0 AS pnl_taken FROM st WHERE rn > 0""",
    }


def stream_sql() -> dict[str, str]:
    """Append-mode streams emit a window once the watermark (newest stamp minus delay) passes."""
    closed = f"""{bars()}, wm AS (SELECT max(ts) - INTERVAL 2 hour AS w FROM events WHERE value > 0),
cb AS MATERIALIZED (SELECT bars.*, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM bars, wm WHERE ts + INTERVAL 1 hour <= w)"""
    at = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
    return {
        "stream_trade_clock": f"""WITH {JOURNAL}, {STREAK}, wm AS (SELECT max(ts)::TIMESTAMP - INTERVAL 1 day AS w FROM j),
t1 AS (SELECT sb.*, CASE WHEN pnl < 0 THEN exit_bar END AS lb FROM sb),
t2 AS (SELECT *, max(lb) OVER (PARTITION BY symbol ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM t1),
t3 AS (SELECT *, sum(CASE WHEN exit_bar - pl >= 6 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS episode FROM t2),
t4 AS (SELECT *, sum(-pnl) OVER (PARTITION BY symbol, episode ORDER BY ts, trade_id) AS s FROM t3),
t5 AS MATERIALIZED (SELECT *, s - least(0, min(s) OVER (PARTITION BY symbol, episode ORDER BY ts, trade_id)) AS to_recover,
  max(CASE WHEN streak <= -3 THEN exit_bar END) OVER (PARTITION BY symbol, side ORDER BY ts, trade_id) AS block_day FROM t4),
unblocked AS (SELECT symbol, side, ts + INTERVAL 8 day AS ts FROM (SELECT *, lead(ts) OVER (PARTITION BY symbol, side ORDER BY ts, trade_id) AS nx FROM t5 WHERE streak <= -3) WHERE nx IS NULL OR nx >= ts + INTERVAL 8 day),
lost AS (SELECT symbol, ts + INTERVAL 6 day AS ts FROM (SELECT *, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS nx FROM t5 WHERE pnl < 0) WHERE nx IS NULL OR nx >= ts + INTERVAL 6 day),
owed AS (SELECT lost.symbol, lost.ts, arg_max(t5.to_recover, (t5.ts, t5.trade_id)) AS to_recover FROM lost JOIN t5 ON t5.symbol = lost.symbol AND t5.ts < lost.ts GROUP BY 1, 2),
every_row AS (SELECT symbol, 'CLOSE' AS kind, side, ts::TIMESTAMP AS ts, trade_id, coalesce(exit_bar < block_day + 8, false) AS blocked, to_recover FROM t5
  UNION ALL SELECT symbol, 'UNBLOCKED', side, ts, -1, false, NULL FROM unblocked
  UNION ALL SELECT symbol, 'WRITTEN_OFF', '', ts, -1, false, to_recover FROM owed WHERE to_recover > 0)
SELECT symbol, kind, side, {at}, CAST(trade_id AS BIGINT) AS trade_id, blocked, round(to_recover, 2) + 0.0 AS to_recover FROM every_row, wm WHERE ts < w""",
        "stream_bar_sentiment": f"""WITH {bars()}, {news('source')}, nr AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][doc_id % 5 + 1] AS symbol, TIMESTAMP '2024-01-01' + INTERVAL 1500 second * doc_id AS nts, news_state FROM hl),
wm AS (SELECT least((SELECT max(ts) FROM bars), (SELECT max(nts) FROM nr)) - INTERVAL 1 hour AS w)
SELECT b.symbol, strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS ts, nr.news_state, strftime(nr.nts, '%Y-%m-%d %H:%M:%S') AS read_at, round(close, 5) + 0.0 AS close
FROM bars b CROSS JOIN wm ASOF LEFT JOIN nr ON b.symbol = nr.symbol AND b.ts >= nr.nts WHERE b.ts < w""",
        "stream_signals_resumed": f"""WITH {bars()}, {ind()}, {REGIME}, {VOTES.replace('SRC', 'reg')}, {HYBRID}, wm AS (SELECT max(ts) - INTERVAL 2 hour AS w FROM hyb WHERE ts >= TIMESTAMP '2024-01-15')
SELECT symbol, {at}, regime, round(ema_long, 4) + 0.0 AS ema_long, round(ema_short, 4) + 0.0 AS ema_short FROM hyb, wm WHERE ts >= TIMESTAMP '2024-01-15' AND ts < w""",
        "stream_closed_bars": f"WITH {closed} SELECT {KEY}, open, high, low, close, volume FROM cb",
        "stream_deduped_candles": "SELECT event_type AS symbol, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT DISTINCT event_type, ts, value FROM events) GROUP BY 1",
        "stream_averages": f"WITH {closed}, a AS (SELECT *, {ema('close', span(9))} AS ema_9, {ema('close', span(21))} AS ema_21, {ema('close', span(50))} AS ema_50 FROM cb) SELECT {KEY}, {r('ema_9 ema_21 ema_50')} FROM a",
        "stream_trade_windows": f"WITH {JOURNAL}, {ROLL20}, {STREAK} SELECT symbol, side, trade_id, n_recent, streak <= -3 AS blocked, round(wr, 5) + 0.0 AS win_rate FROM ka JOIN (SELECT symbol, side, trade_id, streak FROM sb) USING (symbol, side, trade_id)",
        "stream_sentiment_windows": f"""WITH {news('source', AVOID_WORDS, CAUTION_WORDS)}, x AS (SELECT *, TIMESTAMP '2024-01-01' + INTERVAL 1 minute * doc_id AS ts FROM hl), wm AS (SELECT max(ts) - INTERVAL 10 minute AS w FROM x),
g AS (SELECT time_bucket(INTERVAL 5 minute, ts) AS b, count(*) AS headlines, bool_or(news_state = 'AVOID') AS a, bool_or(news_state = 'CAUTION') AS c FROM x GROUP BY 1)
SELECT CASE WHEN a THEN 'AVOID' WHEN c THEN 'CAUTION' ELSE 'NEUTRAL' END AS news_state, count(*) AS n_windows, CAST(sum(headlines) AS BIGINT) AS n_headlines FROM g, wm WHERE b + INTERVAL 5 minute <= w GROUP BY 1""",
    }
