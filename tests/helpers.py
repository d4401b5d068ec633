"""What several test modules use."""

SF = "/root/testdata/sf0.001"


def plain(v):
    """Rows comparable between engines."""
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in cur.fetchall()), key=repr)
    assert ours == theirs

def joined_rows(df):
    """The most rows that a join of df's executed plan gave."""
    df.collect()
    plan, most = df._jdf.queryExecution().executedPlan(), 0
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if "Join" in name:
            most = max(most, node.longMetric("numOutputRows").value())
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return most
