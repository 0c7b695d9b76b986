"""The page command prints every panel of the page."""

from conftest import SF_SMALL


def test_cli_carbon_page(spark, capsys):
    from sitewatt.__main__ import main
    main(["carbon", "--sf", SF_SMALL, "--rows", "1", "--room", "EUROPE"])
    out = capsys.readouterr().out
    for panel in ("current_co2", "rack_carbon_contribution", "carbon_alert_watch", "room_rack_footprint"):
        assert f"== {panel}" in out
