import pytest

from tessera.sources.guard import QueryError, check_sql

QUERIES = [
    'select 1 as x',
    'with a as (select 1 as x) select * from a where x = 1',
    'select * from patients where id in (select user_id from admin_users) order by 1 limit 3',
    'select * from a union all select * from b',
    'select a, count(*) n, sum(x) over (partition by a order by b rows between 3 preceding and current row) from t group by a having count(*) > 1',
    'select * from patients -- comment',
    'select explode(sequence(1,3)) k from range(5)',
    'values (1),(2)',
    'select * from t lateral view explode(x) e as y',
    'select * from information_schema.tables',
    "select * from t pivot (max(v) for k in ('a','b'))",
    "select case when a like 'x%' then 1 end, exists(select 1 from u where u.i = t.i) from t",
    'table t',
    'from t select a',
    'select * from a join lateral (select * from b where b.x = a.x)',
    'select transform(a, x -> x + 1) from t window w as (partition by b)',
]
OTHERS = [
    'with a as (select 1 x) insert into t select * from a',
    'create database y',
    'alter table x rename to y',
    'replace table x using parquet as select 1',
    "load data inpath '/x' into table t",
    "create function f as 'x.y'",
    'analyze table t compute statistics',
    'msck repair table t',
    "comment on table t is 'x'",
    'call x.y()',
    'declare variable v int',
    "execute immediate 'drop table x'",
    'begin select 1; drop table x; end',
    "select reflect('java.lang.System', 'getProperty', 'x')",
    'select * from parquet.`/any/path`',
    'drop table x',
    'insert into t values (1)',
    'update t set a = 1',
    'delete from t',
    'select 1; select 2',
    'set a=b',
    'nonsense',
    'select * from p where 1=1',
    'select * from p where a = 1 or 1=1',
    'select sleep(10)',
    'select password from users',
    'select * from admin',
    'select name from p union select password from users',
    'select * from p where id in (select id from password)',
    "select load_file('/etc/passwd') from p",
    "select * from p into outfile '/tmp/x'",
    "select (select java_method('a','b')) from t",
    "with a as (select reflect('a','b') x) select * from a",
    'show tables',
    'explain select 1',
    'describe t',
    'cache table t',
    'use x',
    "select * from read_files('/x')",
    'merge into t using u on t.a=u.a when matched then delete',
    "insert overwrite directory '/x' select 1",
    'truncate table t',
    'refresh table t',
    'add jar x',
    "select transform(a) using 'cat' as (b) from t",
    'from t insert into u select a',
    'select * from t where exists (select * from json.`/x`)',
]


@pytest.mark.parametrize("sql", QUERIES)
def test_queries_are_accepted(spark, sql):
    check_sql(spark, sql)


@pytest.mark.parametrize("sql", OTHERS)
def test_all_else_is_refused(spark, sql):
    with pytest.raises(QueryError):
        check_sql(spark, sql)
