"""Which statements may be run for a reader: a walk over the plan that Spark makes of one."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Operators of a reading plan. Views are judged by their name and not entered; leaves are judged by LEAVES.
OPERATORS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias Window WithCTE CTERelationDef View Expand Pivot Unpivot WithWindowDefinition"
    " UnresolvedHaving UnresolvedWith UnresolvedSubqueryColumnAliases".split()
)
#: Leaves that read nothing but what the statement itself says.
LEAVES = frozenset("OneRowRelation LocalRelation CTERelationRef UnresolvedInlineTable ResolvedInlineTable".split())
#: Expressions that are computed from values alone.
EXPRESSIONS = frozenset(
    # Names, values, kinds.
    "Alias AttributeReference OuterReference Literal Cast Cube Rollup GroupingSets Grouping GroupingID BaseGroupingSets NamedExpression LateralColumnAliasReference"
    # Logic and comparison.
    " And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual Between In InSet IsNull IsNotNull IsNaN Coalesce NaNvl NullIf Nvl Nvl2 NullIfZero ZeroIfNull If CaseWhen Greatest Least"
    " Like LikeAll LikeAny ILike RLike StartsWith EndsWith Contains StringStartsWith"
    # Numbers.
    " Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs Round BRound Floor RoundFloor Ceil RoundCeil CeilExpressionBuilder FloorExpressionBuilder Sqrt Pow Exp Log Log10 Log2 Logarithm Signum"
    " CheckOverflow TryAdd TryDivide TrySubtract TryMultiply TryEval TryCast WidthBucket"
    # Text.
    " Upper Lower InitCap StringTrim StringTrimLeft StringTrimRight StringTrimBoth Substring Left Right Length CharLength Concat ConcatWs StringReplace StringLPad StringRPad LPad RPad StringInstr StringLocate"
    " RegExpExtract RegExpReplace RegExpCount SplitPart Reverse Overlay StringTranslate"
    # Dates.
    " Year Quarter Month DayOfMonth DayOfWeek DayOfYear WeekDay WeekOfYear Hour Minute Second DateAdd DateSub DateDiff AddMonths MonthsBetween LastDay TruncDate TruncTimestamp DateFormatClass ParseToDate ParseToTimestamp"
    " ToTimestamp GetTimestamp MakeDate CurrentDate CurrentTimestamp Extract DatePart TimestampDiff TimestampAdd DateAddInterval DatetimeSub SubtractDates TimeAdd"
    # Sums.
    " AggregateExpression Count CountIf Sum Average Min Max MinBy MaxBy StddevSamp StddevPop VarianceSamp VariancePop Corr CovSample CovPopulation Median Percentile ApproximatePercentile ApproxCountDistinctForIntervals"
    " HyperLogLogPlusPlus First Last AnyValue BoolAnd BoolOr Mode RegrSlope Skewness Kurtosis PercentileCont PercentileDisc TrySum TryAverage"
    # Windows and order.
    " WindowExpression WindowSpecDefinition SpecifiedWindowFrame UnspecifiedFrame$ CurrentRow$ UnboundedPreceding$ UnboundedFollowing$ RowNumber Rank DenseRank PercentRank CumeDist NTile Lag Lead NthValue SortOrder"
    # Subqueries; their plans are walked as well.
    " ScalarSubquery Exists ListQuery InSubquery LateralSubquery PromotePrecision With CommonExpressionDef CommonExpressionRef TypedNullLiteral".split()
)


def _each(sequence) -> Iterator:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _plans(plan, closed: bool) -> Iterator:
    """The plan and all below it, subqueries and named queries too; views are not entered where closed."""
    yield plan
    if closed and _name(plan) == "View":
        return
    below = list(_each(plan.children())) + list(_each(plan.subqueries()))
    if _name(plan) == "UnresolvedWith":
        below += list(_each(plan.innerChildren()))
    for x in below:
        yield from _plans(x, closed)


def _expressions(plan) -> Iterator:
    todo = list(_each(plan.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo += _each(e.children())


def _relations(plan) -> Iterator[str]:
    for p in _plans(plan, False):
        if _name(p) == "UnresolvedRelation":
            yield ".".join(_each(p.multipartIdentifier()))


def _named(plan) -> set[str]:
    """Names that WITH gives to queries."""
    return {x.alias().lower() for p in _plans(plan, False) if _name(p) == "UnresolvedWith" for x in _each(p.innerChildren()) if _name(x) == "SubqueryAlias"}


def check(spark: SparkSession, statement: str, tables: set[str]) -> None:
    """Raises ValueError unless the statement only reads the given tables.

    The text is parsed first: a relation must bear the name of a table or of one of the statement's own named queries, so
    no path, file or other view is even looked at. The analysed plan must then be of the operators and expressions listed
    above: commands, generators, table functions, scripts, user functions, calls by name into Java and what reads files,
    the session or the clock's host are not among them. Nothing is run.
    """
    state = spark._jsparkSession.sessionState()
    try:
        parsed = state.sqlParser().parsePlan(statement)
    except Exception as wrong:
        raise ValueError("the statement can't be parsed") from wrong
    known = {t.lower() for t in tables}
    for name in _relations(parsed):
        if name.lower() not in known | _named(parsed):
            raise ValueError(f"unknown table: {name}")
    if any(_name(p) not in OPERATORS | LEAVES | {"UnresolvedRelation", "Limit"} for p in _plans(parsed, False)):
        raise ValueError("only one SELECT statement is allowed")
    try:
        analysed = state.analyzer().execute(parsed)
    except Exception as wrong:
        raise ValueError("the statement can't be resolved") from wrong
    for p in _plans(analysed, True):
        if _name(p) not in OPERATORS | LEAVES or (_name(p) == "View" and p.desc().identifier().table().lower() not in known):
            raise ValueError(f"not allowed: {p.nodeName()}")
        if _name(p) == "View":
            continue
        for e in _expressions(p):
            if _name(e) not in EXPRESSIONS:
                raise ValueError(f"not allowed: {e.nodeName()}")
