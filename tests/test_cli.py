import pytest

from tessera.__main__ import main, parser

from .domains import SUPPER


@pytest.mark.parametrize("argv", [["--nothing"], ["-i", "x", "--seed", "-1"], ["-i", "x", "-s", "none"], ["-i", "x", "--validate", "perhaps"], ["-i", "x", "--iteration", "bfs,ff,join"], ["-i", "x", "--iteration", "bfs,ff,join,none"]])
def test_usage_errors(argv):
    with pytest.raises(SystemExit) as e:
        main(argv)
    assert e.value.code == 1


def test_inline_truth_values_and_missing_file(tmp_path):
    assert parser().parse_args(["-i", "x", "--validate", "false"]).validate is False
    assert main(["-i", str(tmp_path / "none.pddl"), "--unit-cost", "true"]) == 33


def test_plan_file(spark, tmp_path):
    domain, problem = tmp_path / "domain.pddl", tmp_path / "p.pddl"
    domain.write_text(SUPPER[0])
    problem.write_text(SUPPER[1])
    assert main(["-i", str(problem), "-s", "bfs", "--plan-file", str(tmp_path / "plan")]) == 0
    assert (tmp_path / "plan").read_text().splitlines()[-1] == "; cost = 2"


def test_iterations(spark, tmp_path):
    domain, problem = tmp_path / "domain.pddl", tmp_path / "p.pddl"
    domain.write_text(SUPPER[0])
    problem.write_text(SUPPER[1])
    assert main(["-i", str(problem), "--iteration", "bfs,blind,join,2", "--iteration", "gbfs,add,join,1", "--plan-file", str(tmp_path / "plan")]) == 0
    assert (tmp_path / "plan.1").read_text().splitlines()[-1] == "; cost = 2"
