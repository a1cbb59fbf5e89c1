import pytest

from skarn import cli
from skarn.plans.tools import tools


@pytest.mark.parametrize("argv", [["search", "red", "--where", "stars > 10", "--sort", "stars:desc", "--limit", "5"], ["facets", "kind", "domains"], ["alternatives", "FIRST"], ["hot", "--domain", "red"], ["run", "k1_popularity"], ["tool", "FIRST"], ["suggest", "helmchart chart"], ["suggest", "secrty scan"], ["rest", "q=red", "sort=stars", "limit=3"], ["suggest", "helm"]])
def test_commands_make_frames(spark, sf, argv):
    first = tools(spark, sf).orderBy("id").first().full_name
    df = cli.frame(spark, cli.parser().parse_args(["--data", sf, *[first if a == "FIRST" else a for a in argv]]))
    assert df.count() > 0 or argv[0] == "suggest"


def test_list_and_bad_commands(capsys):
    assert cli.main(["list"]) == 0 and "a1_facets_all" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
