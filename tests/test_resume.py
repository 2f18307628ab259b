"""Book history resumed from stored spans, and its folds without a sort."""

import contextlib
import io

from tickforge.fixtures import AS_OF
from tickforge.plans import books
from tickforge.plans.orders import order_history_log


def test_resume_from_spans_equals_resume_from_hours(fx):
    middle = books.first_hour(fx.order_history) + 72 * 3600
    until = middle + 48 * 3600
    hours, spans = (f(fx.orders, fx.order_history, middle) for f in (books.book_history_all, books.book_spans_all))
    whole = books.book_history_all(fx.orders, fx.order_history, until).filter(f"hour >= {middle}")
    for stored in (hours, spans):
        got = books.book_history_resume(fx.orders, fx.order_history, stored, until)
        assert got.columns == whole.columns
        assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    assert whole.count() > 0
    done = books.book_history_resume(fx.orders, fx.order_history, spans, middle)
    assert done.columns == whole.columns and done.count() == 0


def test_resume_of_an_empty_history(fx):
    none = fx.order_history.limit(0)
    stored = books.book_spans_all(fx.orders, none, AS_OF)
    assert books.book_history_resume(fx.orders, none, stored, AS_OF).count() == 0


def test_history_folds_by_hash(fx):
    for df in (order_history_log(fx.event_log), books.book_history_all(fx.orders, fx.order_history, AS_OF)):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("simple")
        assert "SortAggregate" not in out.getvalue() and "HashAggregate" in out.getvalue()


def test_hashes_of_any_form_stay_apart(spark):
    log = spark.createDataFrame([("OrderPlaced", 1, "p", 7, h, 10 * n, 0, 0, n) for n, h in enumerate(["ab", "AB", "abc", "0abc", "", None, "zz", "ab"])],
                                "event_name string, chain_id int, address string, order_id long, tx_hash string, block_timestamp long, filled long, status_code int, seq long"
                                ).selectExpr("*", "1L AS quantity")
    got = {r.tx_hash: r.seq for r in order_history_log(log).collect()}
    assert got == {"ab": 7, "AB": 1, "abc": 2, "0abc": 3, "": 4, None: 5, "zz": 6}
    keys = order_history_log(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in keys
