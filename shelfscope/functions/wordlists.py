"""Words that mark URLs as pages of another kind. They must be these for equal results."""

# A path segment at any depth that is never a product page.
JUNK_SEGMENTS = (
    "blog news articles posts about about-us contact contact-us help help-center support faq faqs policy privacy "
    "privacy-policy terms terms-of-service terms-and-conditions shipping shipping-details shipping-policy delivery "
    "delivery-and-return-policy returns return-policy refund refund-policy payment payment-options warranty "
    "warranty-returns careers account my-account cart wishlist checkout login register signup search page pages tag "
    "tags author authors archives guides tutorials reviews resources events team services solutions downloads docs "
    "documentation knowledge-base collections shop-now-pay-later shop-now pay-later track-order order-tracking stores "
    "store-locator affiliate affiliates gift-card gift-cards promotions promo vip membership compare comparison"
).split()

# A first path segment whose children are lists or articles.
SECTION_SEGMENTS = (
    "blog news about about-us contact help faq faqs help-center support policy privacy terms terms-and-conditions "
    "shipping shipping-details returns return-policy payment payment-options warranty warranty-returns careers account "
    "cart wishlist login register search page pages tag tags category categories author authors archives shop "
    "product-category collections catalog catalogue brand brands manufacturer vendor articles posts guides tutorials "
    "reviews resources events team services solutions downloads docs documentation knowledge-base"
).split()

# Places that end the slug of a category landing page, after "-in-".
LANDING_PLACES = (
    "abu-dhabi al-ain dubai sharjah ajman ras-al-khaimah fujairah umm-al-quwain mussafah khalifa-city khalifa "
    "al-reem-island al-reem al-mushrif al-bateen deira jumeirah marina business-bay downtown al-nahda al-qusais mirdif "
    "warsan jebel-ali ras-al-khor al-barsha al-satwa karama bur-dubai al-bustan city-walk mohammed-bin-zayed-city "
    "mbz-city al-samha khalidya muroor al-zahia al-nahyan-camp al-shahama al-raha al-muntazah corniche al-taawun "
    "al-majaz al-ittihad al-rumaila mudon al-furjan al-sofouh al-mankhool al-hudaiba al-fahidi al-ras al-sabkha "
    "al-hamriya al-shindagha al-khwaneej al-warqa al-mizhar al-twar al-mamzar al-hamriyah kalba khorfakkan dibba "
    "al-dhaid madam al-badayer liwa riyadh jeddah dammam khobar al-khobar makkah mecca madinah medina tabuk abha jazan "
    "hail qassim buraidah yanbu taif muscat salalah suhar nizwa sur doha al-rayyan al-wakra al-khor umm-salal al-daayen"
).split()
