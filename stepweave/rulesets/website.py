"""Rule sets of a restaurant ordering website: journey labels and check labels.

Addresses and dish names that belong to one site only are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from stepweave.operators.rules import Rule

PAGE_VIEW, ADD_TO_CART, PURCHASE = "page_view", "add_to_cart", "purchase"
CART_FIELD = "page_location_when_added_to_cart"
LOGIN_FIELD = "logged_in_status"

# Page-view rules in order, as (state, label, pattern). "on" rules apply, "off" rules
# are kept but disabled. ENTREES and HOME stand for the rules that also depend on the site.
ENTREES = (
    "/en/menu/chicken|/en/menu/pasta|/en/menu/salads|/en/menu/from-the-grill|/en/menu/burgers"
    "|/en/menu/sandwiches-and-more|menu/seafood|steaks-and-ribs|fire-grilled-and-chef-selections"
    "|sandwiches|all-you-can-eat|handcrafted-burgers|tex-mex-lime-grilled-shrimp-bowl"
)
HOME = "HOME"

JOURNEY_PAGES = (
    ("on", "Appetizers", "/en/menu/appetizers"),
    ("on", "Entrees", ENTREES),
    ("on", "Menu", "/en/menu$"),
    ("off", "Ala-Carte", "/en/menu/ala-carte"),
    ("on", "Cart", "/en/order/cart"),
    ("on", "Cart Sign In", "/en/accounts/cart-sign-in.*"),
    ("off", "PV: Offers", "en/menu/2-for"),
    ("on", "Drinks", "/en/menu/non-alcoholic-beverages|menu/beer-and-wine"),
    ("on", "Dessert", "/en/menu/dessert"),
    ("on", "Kids Menu", "en/menu/kids-menu"),
    ("on", "Check Out", "en/order/check-out"),
    ("on", "Cross Sell Page", "order/cross-sell-pre-checkout"),
    ("off", "PV: Catering", "en/menu/catering"),
    ("on", "Viewed Family Value Bundles", "menu/family-value-bundles"),
    ("on", "Confirm Restaurant", "en/order/confirm-restaurant"),
    ("on", "Menu Extras", "en/menu/extras"),
    ("on", "Account Sign In", "accounts/sign-in"),
    ("on", "Order Method", "en/order/ordermethod"),
    ("on", "Nutrition", "nutrition"),
    ("off", "PV: Terms of Use", "terms-of-use"),
    ("off", "PV: Order Confirmation", "order/confirmation?"),
    ("on", "My Account", "accounts/my-account"),
    ("off", "PV: Contact Us", "contact-us"),
    ("on", "Gift Cards", "gift-cards"),
    ("on", "Sign Up", "/en/sign-up"),
    ("on", "Home Page", HOME),
    ("on", "Cross-Sell", "/en/order/cross-sell-pre-checkout"),
)

QC_PAGES = (
    ("on", "PV: Appetizers", "/en/menu/appetizers"),
    ("on", "PV: Entrees", ENTREES),
    ("on", "PV:  Menu", "/en/menu$"),
    ("off", "PV: Ala-Carte", "/en/menu/ala-carte"),
    ("on", "PV: Cart", "/en/order/cart"),
    ("on", "PV: Sign In", "/en/accounts/cart-sign-in?returnUrl=/en/order/check-out"),
    ("on", "Page View: Offers", "en/menu/2-for"),
    ("on", "PV: Drinks", "/en/menu/non-alcoholic-beverages|menu/beer-and-wine"),
    ("on", "PV: Dessert", "/en/menu/dessert"),
    ("on", "PV: Kids Menu", "en/menu/kids-menu"),
    ("on", "PV: Check Out", "en/order/check-out"),
    ("on", "PV: Cross Sell Page", "order/cross-sell-pre-checkout"),
    ("off", "PV: Catering", "en/menu/catering"),
    ("on", "PV: Viewed Family Value Bundles", "menu/family-value-bundles"),
    ("on", "PV: Confirm Restaurant", "en/order/confirm-restaurant"),
    ("on", "PV: Menu Extras", "en/menu/extras"),
    ("on", "PV: Account Sign In", "accounts/sign-in"),
    ("on", "PV: Order Method", "en/order/ordermethod"),
    ("on", "PV: Nutrition", "nutrition"),
    ("off", "PV: Terms of Use", "terms-of-use"),
    ("off", "PV: Order Confirmation", "order/confirmation?"),
    ("on", "PV: My Account", "accounts/my-account"),
    ("off", "PV: Contact Us", "contact-us"),
    ("on", "PV: Gift Cards", "gift-cards"),
    ("on", "PV: Sign Up", "/en/sign-up"),
    ("on", "PV: Home Page", HOME),
    ("on", "PV: Cross-Sell", "/en/order/cross-sell-pre-checkout"),
)

# Add-to-cart rules by the address at the time, and one page view among them, all disabled, as
# (label, pattern).
CART_ADDITIONS = (
    ("A2C: Appetizers", "/en/menu/appetizers"),
    (
        "A2C: Entree",
        "/en/menu/chicken|/en/menu/pasta|/en/menu/salads|/en/menu/from-the-grill|/en/menu/burgers"
        "|/en/menu/sandwiches-and-more",
    ),
    ("PV: Menu", "/en/menu$"),
    ("A2C: Al-A-Carte", "/en/menu/ala-carte"),
    ("A2C: 2-For ...", "en/menu/2-for"),
    ("A2C: Dessert", "/en/menu/dessert"),
    ("A2C: Cross-Sell", "/en/order/cross-sell-pre-checkout"),
)


def _page_rules(pages, home_urls: Sequence[str], more_entrees: Sequence[str]) -> list[Rule]:
    rules = []
    for state, label, pattern in pages:
        if pattern is HOME:
            rules += [Rule(label, url, match="equals", event=PAGE_VIEW) for url in home_urls]
            continue
        if pattern is ENTREES:
            pattern = "|".join([ENTREES, *more_entrees])
        rules.append(Rule(label, pattern, event=PAGE_VIEW, enabled=state == "on"))
    return rules


def _event_rules() -> list[Rule]:
    off = [Rule("A2C", match="any", event=ADD_TO_CART, enabled=False)]
    for label, pattern in CART_ADDITIONS:
        if label.startswith("A2C"):
            off.append(Rule(label, pattern, event=ADD_TO_CART, field=CART_FIELD, enabled=False))
        else:
            off.append(Rule(label, pattern, event=PAGE_VIEW, enabled=False))
    off.append(Rule("logged_in", "Logged in", field=LOGIN_FIELD, enabled=False))
    return [*off, Rule("Purchase", match="any", event=PURCHASE)]


def website_rules(home_urls: Sequence[str], more_entrees: Sequence[str] = ()) -> list[Rule]:
    """Labels of journey steps; hits that match none have no group."""
    return _page_rules(JOURNEY_PAGES, home_urls, more_entrees) + _event_rules()


def website_qc_rules(home_urls: Sequence[str], more_entrees: Sequence[str] = ()) -> list[Rule]:
    """Labels of the check query; use with the default ``Other``."""
    return _page_rules(QC_PAGES, home_urls, more_entrees) + _event_rules()
