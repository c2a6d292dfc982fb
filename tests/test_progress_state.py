"""The state that progress reports keep."""


def test_a_new_stream_whose_reports_are_all_out_asks_the_state_once():
    import pandas as pd

    from tidemark.streaming import flows

    calls = []

    class Held:
        def __getattr__(self, name):
            return lambda *args: calls.append(name)  # as a state without a value: None

    reports = flows.ProgressReports(3, 1000)
    reports.handle = reports.state = Held()
    rows = pd.DataFrame({"ms": [5, 3, 4], "seq": [9, 7, 8], "file_id": 1, "end_offset": [90, 70, 80], "chunks": 1})
    out = list(reports.handleInputRows((4,), iter([rows[:1], rows[1:]]), None))
    assert calls == ["get"] and out[0].values.tolist() == [[4, 3, 10, 1, 90, 1000, "COUNT"]]
