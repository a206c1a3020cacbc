"""Joins of a physical plan."""


def merge_joins(df):
    """For each sort-merge join of ``df``'s plan, whether its left and right side are exchanges of their own, so that Spark can split a hot key."""
    out = []

    def below(node):
        while node.nodeName() in ("Sort", "Project", "Filter", "WholeStageCodegen", "InputAdapter"):
            node = node.children().head()
        return node.nodeName()

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if node.nodeName() == "SortMergeJoin":
            out.append((below(node.left()) == "Exchange", below(node.right()) == "Exchange"))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out
